"""Which categories each tile pre-aggregates, under a budget of states.

Pure driver-side arithmetic over the catalog; its size depends on the layout, not on the data.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from dataclasses import dataclass, field

from .catalog import Tile
from .spec import IndexConfig, Range, Rectangle, WindowQuery


@dataclass(frozen=True)
class Attr:
    name: str
    cardinality: int


def _below(v: float, mean: float, sd: float) -> float:
    return 0.5 * (1 + math.erf((v - mean) / (sd * math.sqrt(2))))


@dataclass
class Interest:
    """Where the user will look next: independent normals about the first window, its sides as deviations."""

    q0: WindowQuery
    config: IndexConfig = field(default_factory=IndexConfig)

    def _mass(self, r: Range, about: Range) -> float:
        sd = about.size
        if sd <= 0:
            return 1.0 if r.contains(about.center) else 0.0
        return _below(r.hi, about.center, sd) - _below(r.lo, about.center, sd)

    def probability(self, rect: Rectangle) -> float:
        return self._mass(rect.x, self.q0.rect.x) * self._mass(rect.y, self.q0.rect.y)

    def density(self, rect: Rectangle) -> float:
        return self.probability(rect) / rect.area if rect.area else 0.0

    def score(self, name: str) -> float:
        if name in self.q0.filters:
            return self.config.filter_score
        return self.config.group_score if name in self.q0.group_by else self.config.other_score


@dataclass
class Planner:
    """Utilities, costs and orders that the policies share."""

    interest: Interest
    attrs: list[Attr]
    bounds: Rectangle
    n_rows: int
    sort: str = "asc"
    bins: int = 100
    seed: int = 0

    def __post_init__(self):
        if self.sort not in ("asc", "desc", "rand"):
            raise ValueError(f"unknown attribute order {self.sort!r}")
        self.by_score = sorted(self.attrs, key=lambda a: -self.interest.score(a.name) / max(a.cardinality, 1))
        self._all = sum(self.interest.score(a.name) for a in self.attrs)
        self.random = random.Random(self.seed)

    def tree_utility(self, attrs: list[Attr]) -> float:
        return sum(self.interest.score(a.name) for a in attrs) / self._all if self._all else 0.0

    def utility(self, tile: Tile, attrs: list[Attr]) -> float:
        return self.interest.probability(tile.rect) * self.tree_utility(attrs)

    def expected_rows(self, tile: Tile) -> int:
        return math.ceil(self.n_rows * tile.rect.area / self.bounds.area) if self.bounds.area else self.n_rows

    def cost(self, tile: Tile, attrs: list[Attr]) -> int:
        """States of a tile: each level holds at most as many as the tile has rows."""
        rows, total = self.expected_rows(tile), 0
        for a in attrs:
            total += min(rows, a.cardinality * (total or 1))
        return total

    def ordered(self, attrs: list[Attr]) -> list[Attr]:
        if self.sort == "rand":
            return self.random.sample(attrs, len(attrs))
        return sorted(attrs, key=lambda a: a.cardinality, reverse=self.sort == "desc")

    def prefixes(self) -> list[list[Attr]]:
        return [self.by_score[:n] for n in range(1, len(self.by_score) + 1)]

    def densest(self, tiles: list[Tile]) -> list[Tile]:
        return sorted(tiles, key=lambda t: -self.interest.density(t.rect))

    def total_utility(self, tiles: list[Tile]) -> float:
        named = {a.name: a for a in self.attrs}
        return sum(self.utility(t, [named[x] for x in t.attrs]) for t in tiles)


Assignment = dict[str, tuple[str, ...]]
Policy = Callable[[Planner, list[Tile], float], Assignment]


def _names(attrs: list[Attr]) -> tuple[str, ...]:
    return tuple(a.name for a in attrs)


def none(p: Planner, tiles: list[Tile], budget: float) -> Assignment:
    return {}


def _best_first(p: Planner, tiles: list[Tile], budget: float, choices: list[list[Attr]], order) -> Assignment:
    offers = sorted(((p.utility(t, a), i, j) for i, t in enumerate(tiles) for j, a in enumerate(choices)), key=lambda o: (-o[0], o[1], o[2]))
    chosen: Assignment = {}
    for _, i, j in offers:
        tile, attrs = tiles[i], order(choices[j])
        if tile.id in chosen:
            continue
        cost = p.cost(tile, attrs)
        if cost <= budget:
            budget -= cost
            chosen[tile.id] = _names(attrs)
    return chosen


def greedy(p: Planner, tiles: list[Tile], budget: float) -> Assignment:
    """Any prefix of the score order, by utility."""
    return _best_first(p, tiles, budget, p.prefixes(), p.ordered)


def optimized(p: Planner, tiles: list[Tile], budget: float) -> Assignment:
    """Only the full set, in ascending cardinality, by utility."""
    whole = sorted(p.attrs, key=lambda a: a.cardinality)
    return _best_first(p, tiles, budget, [whole] if whole else [], lambda attrs: attrs)


def _per_bin(p: Planner, groups: list[list[Tile]], budget: float) -> Assignment:
    chosen: Assignment = {}
    for group in groups:
        for attrs in reversed(p.prefixes()):
            own = p.ordered(attrs)
            cost = sum(p.cost(t, own) for t in group)
            if cost <= budget:
                budget -= cost
                chosen |= {t.id: _names(own) for t in group}
                break
    return chosen


def binn(p: Planner, tiles: list[Tile], budget: float) -> Assignment:
    """Bins of equally many tiles by density; each bin gets the longest prefix that it can pay."""
    line, size = p.densest(tiles), max(1, len(tiles) // p.bins)
    return _per_bin(p, [line[i : i + size] for i in range(0, len(line), size)], budget)


def equal_range(p: Planner, tiles: list[Tile], budget: float) -> Assignment:
    """The same with bins of equal density width."""
    density = {t.id: p.interest.density(t.rect) for t in tiles}
    lo, hi = min(density.values()), max(density.values())
    width = (hi - lo) / p.bins
    groups: dict[int, list[Tile]] = {}
    for t in tiles:
        groups.setdefault(min(p.bins - 1, int((density[t.id] - lo) / width)) if width else 0, []).append(t)
    return _per_bin(p, [groups[k] for k in sorted(groups, reverse=True)], budget)


def naive(p: Planner, tiles: list[Tile], budget: float) -> Assignment:
    """The full set, by score, for the densest tiles, until one cannot be paid."""
    chosen: Assignment = {}
    for t in p.densest(tiles):
        budget -= p.cost(t, p.by_score)
        if budget < 0:
            break
        chosen[t.id] = _names(p.by_score)
    return chosen


def random_sets(p: Planner, tiles: list[Tile], budget: float) -> Assignment:
    """Seeded random sets of one or more for the densest tiles; what cannot be paid is passed over. Costs are of the drawn order,
    the tile keeps the set in the planner's."""
    rng, chosen = random.Random(p.seed), {}
    for t in p.densest(tiles) if p.attrs else ():
        if budget <= 0:
            break
        attrs = rng.sample(p.attrs, rng.randint(1, len(p.attrs)))
        cost = p.cost(t, attrs)
        if cost <= budget:
            budget -= cost
            chosen[t.id] = _names(p.ordered(attrs))
    return chosen


def full(p: Planner, tiles: list[Tile], budget: float) -> Assignment:
    return naive(p, tiles, math.inf)


def exhaustive(p: Planner, tiles: list[Tile], budget: float, most: int = 8) -> Assignment:
    """The best assignment of prefixes, trying all; any tile may go without. For few tiles only."""
    if len(tiles) > most:
        raise ValueError(f"exhaustive search takes at most {most} tiles")
    choices = [[], *p.prefixes()]

    def best(i: int, left: float) -> tuple[float, tuple[int, ...]]:
        if i == len(tiles):
            return 0.0, ()
        found = (-1.0, ())
        for j, attrs in enumerate(choices):
            cost = p.cost(tiles[i], p.ordered(attrs) if p.sort != "rand" else attrs)
            if cost <= left:
                value, rest = best(i + 1, left - cost)
                found = max(found, (value + p.utility(tiles[i], attrs), (j, *rest)), key=lambda x: x[0])
        return found

    _, picks = best(0, budget)
    return {t.id: _names(p.ordered(choices[j])) for t, j in zip(tiles, picks, strict=True) if j}


POLICIES: dict[str, Policy] = {
    "valinor": none,
    "greedy": greedy,
    "optimized": optimized,
    "binn": binn,
    "equal_range": equal_range,
    "naive": naive,
    "random": random_sets,
    "full": full,
    "exhaustive": exhaustive,
}


def policy(name: str) -> Policy:
    try:
        return POLICIES[name.lower()]
    except KeyError:
        raise ValueError(f"unknown policy {name!r}; there are {', '.join(POLICIES)}") from None


def budget_for(gigabytes: float, bytes_per_state: float) -> int:
    """How many states fit."""
    return math.floor(gigabytes * 1e9 / bytes_per_state)

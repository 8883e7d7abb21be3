"""Exploration sessions: chains of pans and zooms with sampled filters."""

from __future__ import annotations

import random
from dataclasses import replace

from .policies import Interest
from .spec import DatasetSpec, IndexConfig, Range, Rectangle, WindowQuery

#: Unit steps of the eight directions.
STEPS = {"N": (0, 1), "S": (0, -1), "E": (1, 0), "W": (-1, 0), "NE": (1, 1), "NW": (-1, 1), "SE": (1, -1), "SW": (-1, -1)}
#: Relative weights of directions, by the kind of session.
DIRECTION_WEIGHTS = {
    "synth": {d: 1.0 if d in ("N", "W", "NW") else 0.5 for d in STEPS},
    "taxi": {d: 1.0 if d in ("N", "E", "NE") else 0.5 for d in STEPS},
    "network": {d: 2.0 if d in ("W", "SW") else 0.5 for d in STEPS},
    "even": dict.fromkeys(STEPS, 1.0),
}


def _move(r: Range, by: float) -> Range:
    return Range(r.lo + by, r.hi + by, r.lo_closed, r.hi_closed)


def pan(rect: Rectangle, percent: float, direction: str) -> Rectangle:
    """By a percentage of the window's own sides."""
    dx, dy = STEPS[direction]
    return Rectangle(_move(rect.x, dx * rect.x.size * percent / 100), _move(rect.y, dy * rect.y.size * percent / 100))


def _scaled(r: Range, factor: float) -> Range:
    half = r.size * factor / 2
    return Range(r.center - half, r.center + half, r.lo_closed, r.hi_closed)


def zoom(rect: Rectangle, factor: float) -> Rectangle:
    """About the centre: sides times `factor`."""
    return Rectangle(_scaled(rect.x, factor), _scaled(rect.y, factor))


def zoom_in(rect: Rectangle, factor: float) -> Rectangle:
    return zoom(rect, 1 / factor)


def zoom_out(rect: Rectangle, factor: float) -> Rectangle:
    return zoom(rect, factor)


def step_with_overlap(rect: Rectangle, overlap: float, direction: str) -> Rectangle:
    """To a neighbour that still shares the fraction `overlap` with the window."""
    if direction not in ("N", "S", "E", "W"):
        raise ValueError("only N, S, E and W")
    return pan(rect, (1 - overlap) * 100, direction)


def directions(count: int, weights: str | dict = "synth", seed: int = 0) -> list[str]:
    w = DIRECTION_WEIGHTS[weights] if isinstance(weights, str) else weights
    return random.Random(seed).choices(list(w), list(w.values()), k=count)


def generate(
    q0: WindowQuery,
    count: int,
    spec: DatasetSpec,
    domains: dict[str, list[str]],
    min_shift: int = 10,
    max_shift: int = 10,
    min_filters: int = 0,
    max_filters: int = 0,
    zoom_factor: float = 0.0,
    weights: str | dict = "synth",
    seed: int = 0,
    config: IndexConfig | None = None,
) -> list[WindowQuery]:
    """q0 and its successors: per step a pan or, if the factor exceeds 1, half the time a zoom; and new filters."""
    free = [c for c in spec.cats if c not in q0.group_by]
    if max_filters > len(free):
        raise ValueError(f"at most {len(free)} columns can be filtered")
    rng, interest = random.Random(seed), Interest(q0, config or IndexConfig())
    ways, found, rect = directions(count, weights, seed), [q0], q0.rect
    for way in ways[1:]:
        act = rng.choice(("pan", "pan", "in", "out"))
        if zoom_factor > 1 and act != "pan":
            rect = (zoom_in if act == "in" else zoom_out)(rect, zoom_factor)
        else:
            rect = pan(rect, rng.randint(min_shift, max_shift), way)
        left, filters = list(free), {}
        for _ in range(rng.randint(min_filters, max_filters)):
            c = rng.choices(left, [interest.score(x) for x in left])[0]
            left.remove(c)
            filters[c] = rng.choice(domains[c])
        found.append(replace(q0, rect=rect, filters=filters))
    return found[:count]


def random_windows(bounds: Rectangle, selectivity: float, count: int, seed: int = 0) -> list[Rectangle]:
    """Windows at uniform places whose area is that share of the bounds."""
    rng, side = random.Random(seed), selectivity**0.5

    def part(r: Range) -> Range:
        size = r.size * side
        lo = r.lo + rng.random() * (r.size - size)
        return Range(lo, lo + size)

    return [Rectangle(part(bounds.x), part(bounds.y)) for _ in range(count)]

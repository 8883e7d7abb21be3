"""The tile catalog: a driver-side tree of rectangles, and what the planner knows of each leaf."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np

from .spec import IndexConfig, Range, Rectangle


def cut(r: Range, parts: int) -> list[Range]:
    """`parts` equal ranges: closed below and open above, the last one closed on both sides."""
    edges = np.float32(r.lo) + np.arange(parts + 1, dtype=np.float32) * (np.float32(r.size) / np.float32(parts))
    edges[-1] = r.hi
    return [Range(a, b, True, i == parts - 1) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))]


@dataclass(frozen=True)
class Tile:
    """A leaf: its path as id, nominal rectangle, categories kept, and the data's extent once known."""

    id: str
    rect: Rectangle
    attrs: tuple[str, ...] = ()
    extent: tuple[float, float, float, float] | None = None  # least x, greatest x, least y, greatest y
    rows: int = 0
    odd: int = 0  # rows with one of two measures

    def overlaps(self, rect: Rectangle) -> bool:
        if self.extent is None:
            return self.rect.intersects(rect)
        x0, x1, y0, y1 = self.extent
        return x1 > rect.x.lo and x0 < rect.x.hi and y1 > rect.y.lo and y0 < rect.y.hi

    def contained(self, rect: Rectangle) -> bool:
        if self.extent is None:
            return rect.encloses(self.rect)
        x0, x1, y0, y1 = self.extent
        return rect.contains(x0, y0) and rect.contains(x1, y1)

    def residual(self, rect: Rectangle) -> str:
        """Which axes of the window cut the tile: '', 'x', 'y' or 'xy'."""
        x0, x1, y0, y1 = self.extent or (self.rect.x.lo, self.rect.x.hi, self.rect.y.lo, self.rect.y.hi)
        x_in, y_in = rect.x.contains(x0) and rect.x.contains(x1), rect.y.contains(y0) and rect.y.contains(y1)
        return ("" if x_in else "x") + ("" if y_in else "y")

    @property
    def depth(self) -> int:
        return self.id.count("/") + 1


@dataclass(frozen=True)
class Layout:
    """How points find their tile: a grid, cells with sub-grids, and tiles split in four."""

    bounds: Rectangle
    grid: int
    sub: dict[tuple[int, int], int]
    splits: tuple[str, ...] = ()

    def tiles(self) -> list[Tile]:
        xs, ys = cut(self.bounds.x, self.grid), cut(self.bounds.y, self.grid)
        leaves = []
        for r in range(self.grid):
            for c in range(self.grid):
                cell = Rectangle(xs[c], ys[r])
                k = self.sub.get((r, c), 1)
                if k == 1:
                    leaves.append(Tile(f"{r}.{c}", cell))
                else:
                    sx, sy = cut(cell.x, k), cut(cell.y, k)
                    leaves += [Tile(f"{r}.{c}/{i}.{j}", Rectangle(sx[j], sy[i])) for i in range(k) for j in range(k)]
        for path in self.splits:
            at = next(i for i, t in enumerate(leaves) if t.id == path)
            leaves[at : at + 1] = quarters(leaves[at])
        return leaves


def quarters(tile: Tile) -> list[Tile]:
    """Four children at the midpoint; the lower and left ones hold the middle."""

    def halves(r: Range) -> tuple[Range, Range]:
        mid = np.float32((np.float32(r.lo) + np.float32(r.hi)) / np.float32(2))
        return Range(r.lo, mid, r.lo_closed, True), Range(mid, r.hi, False, r.hi_closed)

    (x0, x1), (y0, y1) = halves(tile.rect.x), halves(tile.rect.y)
    return [Tile(f"{tile.id}/q{i}", Rectangle(x, y), tile.attrs) for i, (x, y) in enumerate([(x0, y0), (x1, y0), (x0, y1), (x1, y1)])]


def splittable(tile: Tile) -> bool:
    """Whether both middles differ from both ends in 32-bit floats."""
    return all(np.float32(r.lo) < np.float32((np.float32(r.lo) + np.float32(r.hi)) / np.float32(2)) < np.float32(r.hi) for r in (tile.rect.x, tile.rect.y))


def layout_for(bounds: Rectangle, config: IndexConfig, probability) -> Layout:
    """A grid whose likely cells are cut finer: k by k with k = floor(sqrt(sub-tiles * probability))."""
    xs, ys = cut(bounds.x, config.grid), cut(bounds.y, config.grid)
    sub = {}
    for r in range(config.grid):
        for c in range(config.grid):
            k = int(np.floor(np.sqrt(config.subtiles * probability(Rectangle(xs[c], ys[r])))))
            if k > 1:
                sub[r, c] = k
    return Layout(bounds, config.grid, sub)


def with_attrs(tiles: list[Tile], attrs: dict[str, tuple[str, ...]]) -> list[Tile]:
    return [replace(t, attrs=tuple(attrs.get(t.id, ()))) for t in tiles]

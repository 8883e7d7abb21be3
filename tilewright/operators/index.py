"""The tiled layout: clustered points, a cube of partial states, and answers from both.

An index is a value. Its state never changes an answer: a tile that lies inside the window, by
the extent of its data, and keeps every asked category answers from the cube; all others are
scanned. `adapt` gives a new index with finer tiles or more categories where a query had to scan.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import has_values, in_window
from ..plans.catalog import Layout, Tile, layout_for, quarters, splittable, with_attrs
from ..plans.policies import Attr, Interest, Planner, policy
from ..plans.spec import DatasetSpec, IndexConfig, Rectangle, WindowQuery
from ..sources.storage import delete, stored_bytes, written
from . import grid, stats
from .direct import Answer, with_measure


#: Tiles that a scan gets as a list.
LISTED = 1_000


@dataclass
class Plan:
    """Tiles whose states answer, tiles that are scanned, and the window's counters."""

    states: list[Tile]
    scans: list[Tile]
    overlapped: int = 0
    contained: int = 0
    unknown: dict[str, tuple[str, ...]] = field(default_factory=dict)

    @property
    def rows_scanned(self) -> int:
        return sum(t.rows for t in self.scans)


@dataclass
class TiledIndex:
    rows: DataFrame
    spec: DatasetSpec
    config: IndexConfig = field(default_factory=IndexConfig)
    policy: str = "binn"
    budget: float = math.inf
    bins: int = 100
    sort: str = "asc"
    seed: int = 0
    layout: Layout | None = None
    tiles: dict[str, Tile] = field(default_factory=dict)
    clustered: DataFrame | None = None
    points: DataFrame | None = None
    cube: DataFrame | None = None
    pivot: tuple[float, float] = (0.0, 0.0)
    changes: dict = field(default_factory=lambda: {"split": 0, "expanded": 0})
    planner: Planner | None = None

    # --- building -----------------------------------------------------------------------

    @property
    def built(self) -> bool:
        return self.cube is not None

    def plan_layout(self, q0: WindowQuery) -> list[Tile]:
        """Tiles and their categories for the first query; one aggregate over the data at most."""
        if self.layout is not None:
            raise RuntimeError("the layout is planned already")
        q0.validate(self.spec)
        ask = [F.count("*").alias("n"), *[F.count_distinct(c).alias(f"d_{c}") for c in self.spec.cats]]
        ask += [f(c).alias(f"{f.__name__}_{c}") for c in ("x", "y") for f in (F.min, F.max)]
        got = self.rows.agg(*ask).first()
        bounds = self.spec.bounds
        if bounds is None:
            bounds = Rectangle.of(got["min_x"], got["max_x"], got["min_y"], got["max_y"]).widened() if got["n"] else Rectangle.of(0, 1, 0, 1)
        interest = Interest(q0, self.config)
        attrs = [Attr(c, got[f"d_{c}"]) for c in self.spec.cats]
        self.planner = Planner(interest, attrs, bounds, self.spec.n_rows or got["n"], self.sort, self.bins, self.seed)
        self.layout = layout_for(bounds, self.config, interest.probability)
        leaves = self.layout.tiles()
        leaves = with_attrs(leaves, policy(self.policy)(self.planner, leaves, self.budget))
        self.tiles = {t.id: t for t in leaves}
        return leaves

    def build(self, q0: WindowQuery) -> TiledIndex:
        if self.layout is None:
            self.plan_layout(q0)
        if self.built:
            raise RuntimeError("the index is built already")
        # one shuffle clusters the table; x in the range lets a hot tile fill several files
        order = ("tile_row", "tile_id", "x")
        placed = grid.assign(self.rows, self.layout).repartitionByRange(*order).sortWithinPartitions(*order)
        self.clustered = self.points = written(placed, "points", "tile_row")
        self.cube = written(self._states(self.points, list(self.tiles.values())), "cube")
        self._measure(self.cube)
        return self

    def _states(self, points: DataFrame, tiles: list[Tile]) -> DataFrame:
        """One row per tile and kept category values: rows, extent, state. A category not kept is null."""
        kept = points.sparkSession.createDataFrame([(t.id, list(t.attrs)) for t in tiles if t.attrs], "_id string, _attrs array<string>")
        got = points.join(F.broadcast(kept), F.col("tile_id") == F.col("_id"), "left")
        for c in self.spec.cats:
            got = got.withColumn(c, F.when(F.array_contains("_attrs", c), F.col(c)))
        has = F.col("m0").isNotNull() & F.col("m1").isNotNull()
        m0, m1 = F.when(has, F.col("m0")), F.when(has, F.col("m1"))
        odd = F.sum((F.col("m0").isNull() != F.col("m1").isNull()).cast("int")).alias("odd")
        extent = [F.count("*").alias("rows"), odd, F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max")]
        return got.groupBy("tile_id", *self.spec.cats).agg(*extent, *stats.state_of(m0, m1))

    def _measure(self, cube: DataFrame) -> None:
        """Extents and counts into the catalog, and the table's means as pivot: one row per tile of the layout at most."""
        sums = [F.sum("n").alias("n"), F.sum(F.col("n") * F.col("mean0")).alias("s0"), F.sum(F.col("n") * F.col("mean1")).alias("s1")]
        seen = cube.groupBy("tile_id").agg(F.sum("rows").alias("rows"), F.min("x_min"), F.max("x_max"), F.min("y_min"), F.max("y_max"), F.sum("odd"), *sums).collect()
        for r in seen:
            self.tiles[r[0]] = replace(self.tiles[r[0]], rows=r[1], extent=(r[2], r[3], r[4], r[5]), odd=r[6])
        n = sum(r["n"] for r in seen)
        means = [sum(r[c] for r in seen if r["n"]) / n if n else 0.0 for c in ("s0", "s1")]
        self.pivot = tuple(m if math.isfinite(m) else 0.0 for m in means)

    # --- answering ----------------------------------------------------------------------

    def overlapping(self, rect: Rectangle) -> list[Tile]:
        return [t for t in self.tiles.values() if t.rows and t.overlaps(rect)]

    def plan(self, query: WindowQuery) -> Plan:
        query.validate(self.spec)
        plan = Plan([], [])
        pair = query.measure is None or len(self.spec.measures) == 1  # else states of tiles where each row has both measures or none
        for t in self.overlapping(query.rect):
            plan.overlapped += 1
            inside = t.contained(query.rect)
            plan.contained += inside
            missing = tuple(c for c in self.spec.cats if c in query.attributes and c not in t.attrs)
            if inside and missing:
                plan.unknown[t.id] = missing
            (plan.states if inside and not missing and (pair or not t.odd) else plan.scans).append(t)
        return plan

    def _within(self, df: DataFrame, tiles: list[Tile], rows: bool) -> DataFrame:
        """Rows of some tiles: partition pruning by grid row; a few tiles as a list that the scan gets, more by a broadcast join (the layout bounds them)."""
        if not tiles:
            return df.where(F.lit(False))
        if rows:
            df = df.where(f"tile_row in ({', '.join(str(r) for r in sorted({int(t.id.split('.')[0]) for t in tiles}))})")
        if len(tiles) <= LISTED:
            return df.where("tile_id in (" + ", ".join(f"'{t.id}'" for t in tiles) + ")")
        ids = df.sparkSession.createDataFrame([(t.id,) for t in tiles], "tile_id string")
        return df.join(F.broadcast(ids), "tile_id", "left_semi")

    def answer(self, query: WindowQuery, q0: WindowQuery | None = None) -> Answer:
        """Builds on the first query, if need be."""
        if not self.built:
            self.build(q0 or query)
        plan, keys = self.plan(query), list(query.group_by)
        two = len(self.spec.measures) == 2 and query.measure is None
        wanted = in_window(query.rect) & has_values(query.filters)
        scanned, _ = with_measure(self._within(self.points, plan.scans, True).where(wanted), self.spec, query)
        parts = stats.of_rows(scanned, keys) if plan.scans or not plan.states else None
        if plan.states:
            known = self._within(self.cube, plan.states, False).where(has_values(query.filters) & (F.col("n") > 0)).select(*keys, *stats.STATE)
            known = known if query.measure is None else stats.of_one(known, self.spec.measures.index(query.measure))
            parts = known if parts is None else parts.unionByName(known)
        pivot = self.pivot if query.measure is None else (self.pivot[self.spec.measures.index(query.measure)], 0.0)
        points = lambda: self._within(self.points, plan.states + plan.scans, True).where(wanted).select("y", "x")
        counters = {
            "tiles": len(self.tiles),
            "overlapped": plan.overlapped,
            "contained": plan.contained,
            "expandable": len(plan.unknown),
            "from_states": len(plan.states),
            "rows_scanned": plan.rows_scanned,
        }
        return Answer(lambda: stats.metrics(stats.merge(parts, keys, pivot), keys, two), lambda: stats.metrics(stats.merge(parts, [], pivot), [], two), points, counters)

    def rows_read(self, query: WindowQuery) -> int:
        """How many points of the window an answer takes from tiles that it scans, counted."""
        return self._within(self.points, self.plan(query).scans, True).where(in_window(query.rect)).count()

    # --- adapting -----------------------------------------------------------------------

    def adapt(self, query: WindowQuery) -> TiledIndex:
        """A new index after `query`: scanned tiles beyond the threshold are split, contained ones learn its categories."""
        plan = self.plan(query)
        split = [t for t in plan.scans if not t.contained(query.rect) and t.rows > self.config.threshold and splittable(t)]
        grown = {} if self.policy == "valinor" else plan.unknown
        if not split and not grown:
            return self
        layout = replace(self.layout, splits=(*self.layout.splits, *[t.id for t in split]))
        tiles = {k: t for k, t in self.tiles.items() if k not in {s.id for s in split}}
        tiles |= {q.id: q for t in split for q in quarters(t)}
        tiles |= {k: replace(tiles[k], attrs=(*tiles[k].attrs, *more)) for k, more in grown.items()}
        changed = [tiles[q.id] for t in split for q in quarters(t)] + [tiles[k] for k in grown]
        # splits rewrite nothing: paths of split tiles are found at read time, and windows prune by x and y
        points = grid.descend(self.clustered, layout)
        new = replace(self, layout=layout, tiles=tiles, points=points, changes={"split": len(split), "expanded": len(grown)})
        old = points.sparkSession.createDataFrame([(t.id,) for t in [*split, *[self.tiles[k] for k in grown]]], "tile_id string")
        fresh = new._states(new._within(points, changed, True), changed)
        new.cube = written(self.cube.join(F.broadcast(old), "tile_id", "left_anti").unionByName(fresh), "cube")
        new._measure(new.cube)
        return new

    # --- what it is ---------------------------------------------------------------------

    @property
    def total_utility(self) -> float:
        return self.planner.total_utility(list(self.tiles.values()))

    def size(self) -> dict:
        return {
            "leaf_tiles": len(self.tiles),
            "max_depth": max((t.depth for t in self.tiles.values()), default=0),
            "states": self.cube.count() if self.built else 0,
            "rows": sum(t.rows for t in self.tiles.values()),
            "utility": self.total_utility,
            "cube_bytes": stored_bytes(self.cube) if self.built else 0,
            "points_bytes": stored_bytes(self.clustered) if self.built else 0,
        }

    def dump(self) -> DataFrame:
        """The catalog as a frame."""
        rows = [(t.id, t.rect.x.lo, t.rect.x.hi, t.rect.y.lo, t.rect.y.hi, list(t.attrs), t.rows) for t in self.tiles.values()]
        return self.rows.sparkSession.createDataFrame(rows, "tile_id string, x_lo float, x_hi float, y_lo float, y_hi float, attrs array<string>, rows long")

    def readout(self, tile_id: str | None = None) -> DataFrame:
        """What is kept of each tile, or of one: category values, rows, and the metrics of their states."""
        keys = ["tile_id", *self.spec.cats]
        kept = self.cube if tile_id is None else self.cube.where(F.col("tile_id") == tile_id)
        return stats.metrics(kept.where("n > 0"), [*keys, "rows"], len(self.spec.measures) == 2)

    def children(self, tile_id: str) -> list[Tile]:
        """Leaves below a path."""
        return [t for t in self.tiles.values() if t.id.startswith(f"{tile_id}/")]

    def close(self) -> None:
        """Delete the tables' files and forget them. Values that share the points lose them too."""
        for table in (self.clustered, self.cube):
            if table is not None:
                delete(table)
        self.clustered = self.points = self.cube = None

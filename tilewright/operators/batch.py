"""A whole session in one job: each query meets only the tiles that it overlaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.spec import WindowQuery
from . import stats
from .index import TiledIndex


def evaluate(index: TiledIndex, queries: list[WindowQuery]) -> DataFrame:
    """(query, one column per category: the group's value or null, metrics).

    The table of (query, tile) pairs is made on the driver from the catalog and joined on the
    tile, with the window and the filters as residual conditions; no pair of a query and a
    point outside its tiles is ever formed.
    """
    spec, spark = index.spec, index.points.sparkSession
    pairs = []
    for i, q in enumerate(queries):
        q.validate(spec)
        r = (q.rect.x.lo, q.rect.x.hi, q.rect.y.lo, q.rect.y.hi)
        pairs += [(i, t.id, *r, *[q.filters.get(c) for c in spec.cats], *[c in q.group_by for c in spec.cats]) for t in index.overlapping(q.rect)]
    schema = "query int, _tile string, _x0 float, _x1 float, _y0 float, _y1 float"
    schema += "".join(f", `_f_{c}` string" for c in spec.cats) + "".join(f", `_g_{c}` boolean" for c in spec.cats)
    table = spark.createDataFrame(pairs, schema)
    near = (F.col("tile_id") == F.col("_tile")) & (F.col("x") > F.col("_x0")) & (F.col("x") < F.col("_x1")) & (F.col("y") > F.col("_y0")) & (F.col("y") < F.col("_y1"))
    for c in spec.cats:
        near = near & (F.col(f"_f_{c}").isNull() | (F.col(f"_f_{c}") == F.col(c)))
    few = len(pairs) <= 500_000
    met = index.points.join(F.broadcast(table) if few else table, near)
    met = met.select("query", "m0", "m1", *[F.when(F.col(f"_g_{c}"), F.col(c)).alias(c) for c in spec.cats])
    keys = ["query", *spec.cats]
    return stats.metrics(stats.aggregate(met, keys), keys, len(spec.measures) == 2)

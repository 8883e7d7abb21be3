"""Tile assignment as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import real
from ..plans.catalog import Layout, cut
from ..plans.spec import Range, f32


def cell(v: Column, lo: Column, width: Column, parts: Column) -> Column:
    """Index of the equal part of an axis that holds `v`, kept within the axis at both ends."""
    at = F.floor(((v - lo) / width).cast("float")).cast("int")
    return F.greatest(F.lit(0), F.least(at, parts - 1))


def grid_index(v: str, axis: Range, parts: int) -> Column:
    return cell(F.col(v), real(axis.lo), real(axis.size / parts), F.lit(parts))


def assign(points: DataFrame, layout: Layout, into: str = "tile_id") -> DataFrame:
    """Adds the path of each point's tile, and `tile_row`, its row in the grid.

    Cells with a sub-grid and tiles split in four come by broadcast joins on the cell or the
    path; both tables are part of the catalog, whose size is set by the layout alone.
    """
    spark, b, g = points.sparkSession, layout.bounds, layout.grid
    got = points.withColumn("tile_row", grid_index("y", b.y, g)).withColumn("_col", grid_index("x", b.x, g))
    path = F.concat_ws(".", F.col("tile_row").cast("string"), F.col("_col").cast("string"))
    extra = ["_col"]
    if layout.sub:
        xs, ys = cut(b.x, g), cut(b.y, g)
        cells = [(r, c, k, xs[c].lo, f32(xs[c].size / k), ys[r].lo, f32(ys[r].size / k)) for (r, c), k in layout.sub.items()]
        table = spark.createDataFrame(cells, "_r int, _c int, _k int, _x float, _w float, _y float, _h float")
        got = got.join(F.broadcast(table), (F.col("tile_row") == F.col("_r")) & (F.col("_col") == F.col("_c")), "left")
        inner = F.concat_ws(".", cell(F.col("y"), F.col("_y"), F.col("_h"), F.col("_k")), cell(F.col("x"), F.col("_x"), F.col("_w"), F.col("_k")))
        path = F.when(F.col("_k").isNull(), path).otherwise(F.concat_ws("/", path, inner))
        extra += ["_r", "_c", "_k", "_x", "_w", "_y", "_h"]
    got = got.withColumn(into, path).drop(*extra)
    return descend(got, layout, into)


def descend(points: DataFrame, layout: Layout, into: str = "tile_id") -> DataFrame:
    """Sends points of split tiles to their quarters, one level of splits at a time."""
    if not layout.splits:
        return points
    known = {t.id: t for t in Layout(layout.bounds, layout.grid, layout.sub).tiles()}
    levels: dict[int, list] = {}
    from ..plans.catalog import quarters

    for path in layout.splits:
        children = quarters(known[path])
        known |= {t.id: t for t in children}
        low = children[0].rect
        levels.setdefault(path.count("q"), []).append((path, low.x.hi, low.y.hi))
    got = points
    for depth in sorted(levels):
        table = points.sparkSession.createDataFrame(levels[depth], "_path string, _mx float, _my float")
        got = got.join(F.broadcast(table), F.col(into) == F.col("_path"), "left")
        quarter = (F.col("x") > F.col("_mx")).cast("int") + 2 * (F.col("y") > F.col("_my")).cast("int")
        got = got.withColumn(into, F.when(F.col("_path").isNull(), F.col(into)).otherwise(F.concat(F.col(into), F.lit("/q"), quarter.cast("string")))).drop("_path", "_mx", "_my")
    return got


def extents(points: DataFrame, key: str = "tile_id") -> DataFrame:
    return points.groupBy(key).agg(F.count("*").alias("rows"), F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"))


def dictionary(df: DataFrame, column: str, order: str) -> DataFrame:
    """(value, code): codes by first appearance, a missing value being `N/A`."""
    from pyspark.sql import Window as W

    from ..functions.columns import MISSING

    first = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(MISSING)).alias("value")).agg(F.min(order).alias("first"))
    # one row per distinct value: the sort is over the dictionary, not the table
    return first.select("value", (F.row_number().over(W.orderBy("first", "value")) - 1).alias("code"))

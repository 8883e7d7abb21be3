"""The registered queries of the engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import MISSING, compare, in_window, zone_test
from ..operators import batch, direct, grid, stats
from ..operators.index import TiledIndex
from ..sources import tables
from ..sources.storage import shared_folder
from . import policies, session
from .catalog import Layout, cut, quarters
from .spec import DatasetSpec, IndexConfig, Rectangle, WindowQuery, f32

# --- roles ------------------------------------------------------------------------------

BOUNDS_L = Rectangle.of(900, 105000, 0, 51)
L = DatasetSpec("l_extendedprice", "l_quantity", ("l_returnflag", "l_linestatus", "l_linenumber"), ("l_discount", "l_tax"), BOUNDS_L)
L1 = replace(L, measures=("l_discount",))
E = DatasetSpec("hours", "user_id", ("event_type",), ("value",), Rectangle.of(-1, 721, -1, 1_000_000))
O = DatasetSpec("o_totalprice", "days", ("o_orderstatus", "o_orderpriority"), ("thousands",), Rectangle.of(1000, 500000, -1, 2410))  # noqa: E741

FLAGSHIP = WindowQuery(Rectangle.of(20000, 60000, 10, 30), {"l_linestatus": "O"}, ("l_returnflag",))
NEAR = WindowQuery(Rectangle.of(40000, 46000, 20, 24), {"l_linestatus": "O"}, ("l_returnflag",))
CONFIG = IndexConfig(grid=20)


def lineitem(spark: SparkSession, sf_dir: str, spec: DatasetSpec = L) -> DataFrame:
    return direct.prepare(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), spec)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    hours = (F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 3600000000
    return direct.prepare(df.select(hours.alias("hours"), "user_id", "event_type", "value"), E)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date"))
    return direct.prepare(df.select("o_totalprice", days.alias("days"), "o_orderstatus", "o_orderpriority", (F.col("o_totalprice") / 1000).alias("thousands")), O)


# --- SQL parts --------------------------------------------------------------------------

_L = (
    "(SELECT l_extendedprice::FLOAT AS x, l_quantity::FLOAT AS y, coalesce(l_returnflag, 'N/A') AS l_returnflag, coalesce(l_linestatus, 'N/A') AS l_linestatus, "
    "coalesce(l_linenumber::VARCHAR, 'N/A') AS l_linenumber, l_discount AS m0, l_tax AS m1, l_orderkey, l_partkey FROM lineitem "
    "WHERE l_extendedprice::FLOAT > 900 AND l_extendedprice::FLOAT < 105000 AND l_quantity::FLOAT > 0 AND l_quantity::FLOAT < 51)"
)
_L1 = _L.replace("l_tax AS m1", "0.0::DOUBLE AS m1")
_E = "(SELECT ((epoch_us(ts) - 1704067200000000) / 3600000000)::FLOAT AS x, user_id::FLOAT AS y, coalesce(event_type, 'N/A') AS event_type, value AS m0, 0.0::DOUBLE AS m1 FROM events)"
_O = (
    "(SELECT o_totalprice::FLOAT AS x, date_diff('day', DATE '1995-01-01', o_orderdate::DATE)::FLOAT AS y, coalesce(o_orderstatus, 'N/A') AS o_orderstatus, "
    "coalesce(o_orderpriority, 'N/A') AS o_orderpriority, o_totalprice / 1000 AS m0, 0.0::DOUBLE AS m1 FROM orders)"
)
#: Added before rounding, on both sides.
ODD = 1.234567e-9


def _f(v: float) -> str:
    return f"CAST({f32(v)!r} AS FLOAT)"


def _window(r: Rectangle) -> str:
    return f"x > {_f(r.x.lo)} AND x < {_f(r.x.hi)} AND y > {_f(r.y.lo)} AND y < {_f(r.y.hi)}"


def _where(q: WindowQuery) -> str:
    return " AND ".join([_window(q.rect), *[f"{c} = '{v}'" for c, v in q.filters.items()]])


def _stats(two: bool, places: int = 6) -> str:
    r = lambda e, name: f"round({e} + {ODD!r}, {places}) AS {name}"
    out = ["count(m0) AS n"]
    for i in (0, 1) if two else (0,):
        m = f"m{i}"
        out += [r(f"sum({m})", f"sum{i}"), r(f"avg({m})", f"mean{i}"), r(f"min({m})", f"min{i}"), r(f"max({m})", f"max{i}")]
        out += [r(f"var_pop({m})", f"var_pop{i}"), r(f"var_samp({m})", f"var_samp{i}"), r(f"stddev_pop({m})", f"std_pop{i}"), r(f"stddev_samp({m})", f"std_samp{i}")]
    flat = "CASE WHEN var_pop(m0) = 0 THEN NULL ELSE {} END"
    out += [r("covar_pop(m0, m1)", "covar_pop"), r("covar_samp(m0, m1)", "covar_samp"), r("covar_pop(m0, m1) / nullif(stddev_pop(m0) * stddev_pop(m1), 0)", "corr")]
    out += [r(flat.format("covar_pop(m0, m1) / var_pop(m0)"), "slope"), r(flat.format("avg(m1) - covar_pop(m0, m1) / var_pop(m0) * avg(m0)"), "intercept")]
    return ", ".join(out)


def _sql(table: str, q: WindowQuery, two: bool, places: int = 6) -> str:
    keys = "".join(f"{k}, " for k in q.group_by)
    group = f" GROUP BY {', '.join(q.group_by)}" if q.group_by else ""
    return f"SELECT {keys}{_stats(two, places)} FROM {table} WHERE {_where(q)} AND m0 IS NOT NULL AND m1 IS NOT NULL{group} HAVING count(*) > 0"


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to so many places, less an odd trifle: exact halves would fall either way by the order of sums."""
    return df.select(*[(F.round(F.col(c) + F.lit(ODD), places) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


# --- direct answers ---------------------------------------------------------------------

_register("window_count", f"SELECT count(*) AS n FROM {_L} WHERE {_window(FLAGSHIP.rect)}")(
    lambda spark, d: lineitem(spark, d).where(in_window(FLAGSHIP.rect)).agg(F.count("*").alias("n"))
)


def _direct(name: str, q: WindowQuery, table: str, load, spec: DatasetSpec, two: bool, places: int = 6):
    _register(name, _sql(table, q, two, places))(lambda spark, d: rounded(direct.answer(load(spark, d), spec, q).groups, places))


_direct("window_filter_group_stats", FLAGSHIP, _L1, lambda s, d: lineitem(s, d, L1), L1, False)
_direct("window_multi_group", replace(FLAGSHIP, filters={}, group_by=("l_returnflag", "l_linenumber")), _L, lineitem, L, True)
_direct("window_global_stats", replace(FLAGSHIP, group_by=()), _L, lineitem, L, True)
_direct("paired_stats", replace(FLAGSHIP, filters={}, group_by=("l_linestatus",)), _L, lineitem, L, True)
_direct("single_measure_paired", replace(NEAR, filters={}), _L1, lambda s, d: lineitem(s, d, L1), L1, False)
_direct("one_of_two_measures", replace(FLAGSHIP, measure="l_tax"), _L1.replace("l_discount AS m0", "l_tax AS m0"), lineitem, L, False)
_direct("window_outside_bounds", replace(FLAGSHIP, rect=Rectangle.of(200000, 300000, 10, 30)), _L, lineitem, L, True)
_direct("unseen_filter_value", replace(FLAGSHIP, filters={"l_linestatus": "Z"}), _L, lineitem, L, True)
_direct("events_window", WindowQuery(Rectangle.of(100, 400, 20, 90), {}, ("event_type",)), _E, events, E, False, 4)
_direct("orders_window", WindowQuery(Rectangle.of(50000, 300000, 300, 1500), {"o_orderstatus": "O"}, ("o_orderpriority",)), _O, orders, O, False, 4)

_register("window_total", _sql(_L, replace(FLAGSHIP, group_by=()), True))(lambda spark, d: rounded(direct.answer(lineitem(spark, d), L, FLAGSHIP).total))


_register(
    "window_total_rollup",
    f"SELECT l_returnflag, (grouping(l_returnflag) = 1) AS is_total, {_stats(True)} FROM {_L} WHERE {_where(FLAGSHIP)} GROUP BY ROLLUP (l_returnflag)",
)(lambda spark, d: rounded(direct.rollup(lineitem(spark, d), L, FLAGSHIP)))

_register("window_points", f"SELECT y, x FROM {_L} WHERE {_where(NEAR)}")(lambda spark, d: direct.answer(lineitem(spark, d), L, NEAR).points)


@_register(
    "window_points_by_row_order",
    f"SELECT row_id, y, x FROM (SELECT x, y, l_linestatus, l_orderkey * 8 + l_linenumber::BIGINT AS row_id FROM {_L}) WHERE {_where(replace(NEAR, filters={}))} ORDER BY row_id",
)
def _ordered_points(spark: SparkSession, d: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/lineitem.parquet").withColumn("row", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    return direct.prepare(df, L, row_id="row").where(in_window(NEAR.rect)).select("row_id", "y", "x").orderBy("row_id")


_NARROW = Rectangle.of(21000, 50000, 12, 25)
_register("window_beyond_bounds", _sql(f"(SELECT * FROM {_L} WHERE {_window(_NARROW)})", replace(FLAGSHIP, filters={}), True))(
    lambda spark, d: rounded(direct.answer(lineitem(spark, d, replace(L, bounds=_NARROW)), L, replace(FLAGSHIP, filters={})).groups)
)


@_register("missing_measure", _sql(_L.replace("l_discount AS m0", "nullif(l_discount, 0.05) AS m0").replace("l_tax AS m1", "nullif(l_tax, 0.02) AS m1"), FLAGSHIP, True))
def _missing_measure(spark: SparkSession, d: str) -> DataFrame:
    """Rows that lack a measure are points and take no part in paired statistics."""
    df = spark.read.parquet(f"{d}/lineitem.parquet").withColumns({"l_discount": F.nullif("l_discount", F.lit(0.05)), "l_tax": F.nullif("l_tax", F.lit(0.02))})
    return rounded(direct.answer(direct.prepare(df, L), L, FLAGSHIP).groups)


_NA = WindowQuery(FLAGSHIP.rect, {"l_returnflag": MISSING}, ("l_linestatus",))


@_register("category_na", _sql(_L1.replace("coalesce(l_returnflag, 'N/A')", "coalesce(nullif(l_returnflag, 'A'), 'N/A')"), _NA, False))
def _category_na(spark: SparkSession, d: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/lineitem.parquet").withColumn("l_returnflag", F.nullif("l_returnflag", F.lit("A")))
    return rounded(direct.answer(direct.prepare(df, L1), L1, _NA).groups)


for _name, _op in {"lt": "<", "le": "<=", "gt": ">", "ge": ">=", "eq": "=", "ne": "!="}.items():
    _register(f"numeric_predicate_{_name}", f"SELECT count(*) AS n, round(sum(m0), 6) AS s FROM {_L} WHERE y {_op} {_f(25)}")(
        lambda spark, d, op=_op: lineitem(spark, d).where(compare("y", op, 25)).agg(F.count("*").alias("n"), F.round(F.sum("m0"), 6).alias("s"))
    )

# --- sources ----------------------------------------------------------------------------

_register("dataset_bounds", "SELECT min(l_extendedprice::FLOAT) AS x_min, max(l_extendedprice::FLOAT) AS x_max, min(l_quantity::FLOAT) AS y_min, max(l_quantity::FLOAT) AS y_max FROM lineitem")(
    lambda spark, d: tables.bounds(spark.read.parquet(f"{d}/lineitem.parquet"), L.x, L.y)
)
_register("domain_sizes", "SELECT " + ", ".join(f"count(DISTINCT coalesce({c}::VARCHAR, 'N/A')) AS {c}" for c in L.cats) + " FROM lineitem")(
    lambda spark, d: tables.domain_sizes(spark.read.parquet(f"{d}/lineitem.parquet"), list(L.cats))
)
_register("domain_sizes_sampled", "SELECT " + ", ".join(f"count(DISTINCT coalesce({c}::VARCHAR, 'N/A')) AS {c}" for c in L.cats) + " FROM (SELECT * FROM lineitem LIMIT 2000)")(
    lambda spark, d: tables.domain_sizes(spark.read.parquet(f"{d}/lineitem.parquet"), list(L.cats), 2000)
)
_register(
    "dictionary_encode",
    "SELECT value, row_number() OVER (ORDER BY f, value) - 1 AS code FROM (SELECT coalesce(event_type, 'N/A') AS value, min(event_id) AS f FROM events GROUP BY 1)",
)(lambda spark, d: grid.dictionary(spark.read.parquet(f"{d}/events.parquet"), "event_type", "event_id"))

_CSV = DatasetSpec("c0", "c1", ("c2", "c4"), ("c3",), Rectangle.of(900, 105000, 0, 51), columns=("c0", "c1", "c2", "c3", "c4"))
_CSV_QUERY = WindowQuery(FLAGSHIP.rect, {"c4": "O"}, ("c2",))


@_register("csv_scan", _sql(_L1.replace("AS l_returnflag", "AS c2").replace("AS l_linestatus", "AS c4"), _CSV_QUERY, False))
def _csv_scan(spark: SparkSession, d: str) -> DataFrame:
    """Through a delimited file with rows that cannot be read: they change nothing."""
    import uuid

    path = f"{shared_folder(spark)}/tilewright/{uuid.uuid4().hex}/csv"
    df = spark.read.parquet(f"{d}/lineitem.parquet").select(*[F.col(c).cast("string") for c in ("l_extendedprice", "l_quantity", "l_returnflag", "l_discount", "l_linestatus")])
    bad = spark.createDataFrame([("abc", "2", "A", "3", "O"), (None, None, None, None, None), ("#c", "1", "1", "1", "O")], df.schema)
    tables.write_csv(df.unionAll(bad), path)
    return rounded(direct.answer(direct.prepare(tables.read_csv(spark, path, _CSV), _CSV), _CSV, _CSV_QUERY).groups)


_register("synthetic_table")(lambda spark, d: tables.preset(spark, "synth10", rows=1000, seed=1))

# --- grid -------------------------------------------------------------------------------


def _layout(q: WindowQuery) -> Layout:
    from .catalog import layout_for

    return layout_for(BOUNDS_L, CONFIG, policies.Interest(q, CONFIG).probability)


def _index_sql(v: str, lo: str, w: str, k: str) -> str:
    return f"greatest(0, least(floor((({v} - {lo}) / {w})::FLOAT)::INT, {k} - 1))"


_ROW = _index_sql("y", _f(BOUNDS_L.y.lo), _f(BOUNDS_L.y.size / 20), "20")
_COL = _index_sql("x", _f(BOUNDS_L.x.lo), _f(BOUNDS_L.x.size / 20), "20")
_GRID = f"(SELECT *, {_ROW} AS tile_row, {_COL} AS tile_col, {_ROW}::VARCHAR || '.' || {_COL}::VARCHAR AS tile_id FROM {_L})"
_PLAIN = Layout(BOUNDS_L, 20, {})


def _sub_sql(layout: Layout) -> str:
    xs, ys = cut(layout.bounds.x, layout.grid), cut(layout.bounds.y, layout.grid)
    values = ", ".join(f"({r}, {c}, {k}, {_f(xs[c].lo)}, {_f(xs[c].size / k)}, {_f(ys[r].lo)}, {_f(ys[r].size / k)})" for (r, c), k in layout.sub.items())
    inner = f"{_index_sql('y', 'sy', 'sh', 'k')}::VARCHAR || '.' || {_index_sql('x', 'sx', 'sw', 'k')}::VARCHAR"
    return (
        f"(SELECT g.* EXCLUDE (tile_id), CASE WHEN k IS NULL THEN tile_id ELSE tile_id || '/' || {inner} END AS tile_id "
        f"FROM {_GRID} g LEFT JOIN (VALUES {values}) AS s(sr, sc, k, sx, sw, sy, sh) ON tile_row = sr AND tile_col = sc)"
    )


_SUB = _layout(NEAR)
_SPLIT_AT = ("9.7", "9.8", "10.8")
_QUAD = Layout(BOUNDS_L, 20, {}, _SPLIT_AT)


def _quad_sql(layout: Layout) -> str:
    known = {t.id: t for t in _PLAIN.tiles()}
    cases = []
    for p in layout.splits:
        low = quarters(known[p])[0].rect
        cases.append(f"WHEN tile_id = '{p}' THEN tile_id || '/q' || ((x > {_f(low.x.hi)})::INT + 2 * (y > {_f(low.y.hi)})::INT)::VARCHAR")
    return f"(SELECT * EXCLUDE (tile_id), CASE {' '.join(cases)} ELSE tile_id END AS tile_id FROM {_GRID})"


def _counted(name: str, layout: Layout, table: str):
    _register(name, f"SELECT tile_id, count(*) AS n FROM {table} GROUP BY tile_id")(
        lambda spark, d: grid.assign(lineitem(spark, d), layout).groupBy("tile_id").agg(F.count("*").alias("n"))
    )


_counted("grid_assign", _PLAIN, _GRID)
_counted("subgrid_assign", _SUB, _sub_sql(_SUB))
_counted("quadtree_assign", _QUAD, _quad_sql(_QUAD))

_register("grid_tile_stats", f"SELECT tile_id, {_stats(True)} FROM {_GRID} GROUP BY tile_id")(
    lambda spark, d: rounded(stats.metrics(stats.aggregate(grid.assign(lineitem(spark, d), _PLAIN), ["tile_id"]), ["tile_id"]))
)
_register("tile_cube", f"SELECT tile_id, l_returnflag, l_linestatus, {_stats(True)} FROM {_GRID} GROUP BY ALL")(
    lambda spark, d: rounded(stats.metrics(stats.aggregate(grid.assign(lineitem(spark, d), _PLAIN), ["tile_id", "l_returnflag", "l_linestatus"]), ["tile_id", "l_returnflag", "l_linestatus"]))
)
_register("cube_rollup_merge", f"SELECT l_returnflag, {_stats(True)} FROM {_L} GROUP BY l_returnflag")(
    lambda spark, d: rounded(
        stats.metrics(stats.merge(stats.aggregate(grid.assign(lineitem(spark, d), _PLAIN), ["tile_id", "l_returnflag", "l_linestatus"]), ["l_returnflag"]), ["l_returnflag"])
    )
)

_EXTENT = f"(SELECT tile_id, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max FROM {_GRID} GROUP BY tile_id)"
_R = FLAGSHIP.rect
_OVER = f"x_max > {_f(_R.x.lo)} AND x_min < {_f(_R.x.hi)} AND y_max > {_f(_R.y.lo)} AND y_min < {_f(_R.y.hi)}"
_IN_X = f"(x_min > {_f(_R.x.lo)} AND x_max < {_f(_R.x.hi)})"
_IN_Y = f"(y_min > {_f(_R.y.lo)} AND y_max < {_f(_R.y.hi)})"


def _seen_tiles(spark: SparkSession, d: str):
    got = grid.extents(grid.assign(lineitem(spark, d), _PLAIN)).collect()  # one row per tile of the layout
    named = {t.id: t for t in _PLAIN.tiles()}
    return [replace(named[r["tile_id"]], rows=r["rows"], extent=(r["x_min"], r["x_max"], r["y_min"], r["y_max"])) for r in got]


_register("overlapping_tiles", f"SELECT tile_id FROM {_EXTENT} WHERE {_OVER}")(
    lambda spark, d: spark.createDataFrame([(t.id,) for t in _seen_tiles(spark, d) if t.overlaps(_R)], "tile_id string")
)
_register(
    "containment_classify",
    f"SELECT tile_id, ({_IN_X} AND {_IN_Y}) AS contained, CASE WHEN {_IN_X} THEN '' ELSE 'x' END || CASE WHEN {_IN_Y} THEN '' ELSE 'y' END AS residual FROM {_EXTENT} WHERE {_OVER}",
)(
    lambda spark, d: spark.createDataFrame(
        [(t.id, t.contained(_R), t.residual(_R)) for t in _seen_tiles(spark, d) if t.overlaps(_R)], "tile_id string, contained boolean, residual string"
    )
)
_register(
    "zone_map_test",
    f"SELECT tile_id, CASE WHEN hi < {_f(25)} THEN true WHEN lo >= {_f(25)} THEN false END AS below, CASE WHEN lo > {_f(25)} THEN true WHEN hi <= {_f(25)} THEN false END AS above "
    f"FROM (SELECT tile_id, min(y) AS lo, max(y) AS hi FROM {_GRID} GROUP BY tile_id)",
)(
    lambda spark, d: grid.assign(lineitem(spark, d), _PLAIN)
    .groupBy("tile_id")
    .agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    .select("tile_id", zone_test("<", 25).alias("below"), zone_test(">", 25).alias("above"))
)

# --- indexed answers --------------------------------------------------------------------


def _index(spark: SparkSession, d: str, name: str, budget: float = 4000, q0: WindowQuery = FLAGSHIP) -> TiledIndex:
    return TiledIndex(lineitem(spark, d), L, CONFIG, name, budget, bins=20).build(q0)


_FLAG_SQL = _sql(_L, FLAGSHIP, True)
for _name in ("valinor", "greedy", "optimized", "binn", "equal_range", "naive", "random", "full"):
    _register(f"indexed_answer_{_name}", _FLAG_SQL)(lambda spark, d, name=_name: rounded(_index(spark, d, name).answer(FLAGSHIP).groups))

_ONE = replace(FLAGSHIP, measure="l_tax")
_register("indexed_one_of_two_measures", _sql(_L1.replace("l_discount AS m0", "l_tax AS m0"), _ONE, False))(lambda spark, d: rounded(_index(spark, d, "full").answer(_ONE).groups))

_MORE = replace(FLAGSHIP, filters={"l_linenumber": "2"}, group_by=("l_returnflag", "l_linestatus"))
_CORNER = replace(FLAGSHIP, rect=Rectangle.of(21000, 58000, 11.5, 29.5))

_register("indexed_total", _sql(_L, replace(FLAGSHIP, group_by=()), True))(lambda spark, d: rounded(_index(spark, d, "full").answer(FLAGSHIP).total))
_register("indexed_points", f"SELECT y, x FROM {_L} WHERE {_where(NEAR)}")(lambda spark, d: _index(spark, d, "binn").answer(NEAR).points)
_register("indexed_small_window", _sql(_L, NEAR, True))(lambda spark, d: rounded(_index(spark, d, "binn", q0=NEAR).answer(NEAR).groups))
_register("after_split", _sql(_L, _CORNER, True))(
    lambda spark, d: rounded(replace(i := _index(spark, d, "valinor"), config=replace(CONFIG, threshold=100)).adapt(_CORNER).answer(_CORNER).groups)
)
_register("after_expand", _sql(_L, _MORE, True))(lambda spark, d: rounded(_index(spark, d, "binn", 500).adapt(_MORE).answer(_MORE).groups))
_register("after_enrich", _FLAG_SQL)(lambda spark, d: rounded(_index(spark, d, "greedy", 100).adapt(_MORE).adapt(FLAGSHIP).answer(FLAGSHIP).groups))

# --- sessions and planning --------------------------------------------------------------

_DOMAINS = {"l_returnflag": ["A", "N", "R"], "l_linestatus": ["F", "O"], "l_linenumber": [str(i) for i in range(1, 8)]}
_SESSION = session.generate(FLAGSHIP, 12, L, _DOMAINS, min_filters=0, max_filters=2, zoom_factor=1.5, seed=7)


def _batch_sql() -> str:
    one = []
    for i, q in enumerate(_SESSION):
        keys = ", ".join(c if c in q.group_by else f"NULL::VARCHAR AS {c}" for c in L.cats)
        one.append(f"SELECT {i}::INT AS query, {keys}, {_stats(True)} FROM {_L} WHERE {_where(q)} GROUP BY {', '.join(q.group_by)} HAVING count(*) > 0")
    return " UNION ALL ".join(one)


_register("session_batch", _batch_sql())(lambda spark, d: rounded(batch.evaluate(_index(spark, d, "valinor"), _SESSION)))


def _windows() -> list[tuple]:
    r = FLAGSHIP.rect
    steps = [("pan", session.pan(r, 10, "NE")), ("in", session.zoom_in(r, 2)), ("out", session.zoom_out(r, 2)), ("overlap", session.step_with_overlap(r, 0.75, "W"))]
    return [(n, w.x.lo, w.x.hi, w.y.lo, w.y.hi) for n, w in steps]


_register(
    "session_pan_zoom",
    "SELECT * FROM (VALUES ('pan', 24000.0::FLOAT, 64000.0::FLOAT, 12.0::FLOAT, 32.0::FLOAT), ('in', 30000.0, 50000.0, 15.0, 25.0), "
    "('out', 0.0, 80000.0, 0.0, 40.0), ('overlap', 10000.0, 50000.0, 10.0, 30.0)) AS w(step, x0, x1, y0, y1)",
)(lambda spark, d: spark.createDataFrame(_windows(), "step string, x0 float, x1 float, y0 float, y1 float"))


@_register("policy_assignments")
def _assignments(spark: SparkSession, d: str) -> DataFrame:
    rows = []
    base = TiledIndex(lineitem(spark, d), L, CONFIG, "valinor")
    base.plan_layout(FLAGSHIP)
    leaves = list(base.tiles.values())
    for name in ("valinor", "greedy", "optimized", "binn", "equal_range", "naive", "random", "full"):
        for tile, attrs in policies.policy(name)(base.planner, leaves, 4000).items():
            rows.append((name, tile, ",".join(attrs)))
    return spark.createDataFrame(rows, "policy string, tile_id string, attrs string")


@_register("planner_utilities")
def _utilities(spark: SparkSession, d: str) -> DataFrame:
    base = TiledIndex(lineitem(spark, d), L, CONFIG, "valinor")
    base.plan_layout(FLAGSHIP)
    p = base.planner
    rows = [(t.id, p.interest.probability(t.rect), p.interest.density(t.rect), p.expected_rows(t), p.cost(t, p.by_score), p.utility(t, p.by_score)) for t in base.tiles.values()]
    return spark.createDataFrame(rows, "tile_id string, probability double, density double, expected_rows long, cost long, utility double")


@_register("exhaustive_assignment")
def _exhaustive(spark: SparkSession, d: str) -> DataFrame:
    """The best assignment over a layout of four tiles, trying all."""
    base = TiledIndex(lineitem(spark, d), L, IndexConfig(grid=2, subtile_ratio=0.0), "valinor")
    leaves = base.plan_layout(FLAGSHIP)
    found = policies.policy("exhaustive")(base.planner, leaves, 60)
    return spark.createDataFrame([(t.id, ",".join(found.get(t.id, ()))) for t in leaves], "tile_id string, attrs string")


def _costs_sql() -> str:
    """States of each tile by the order of scores: status (filtered, 2 values), flag (grouped, 3), number (7)."""
    xs, ys = cut(BOUNDS_L.x, 20), cut(BOUNDS_L.y, 20)
    sides = ", ".join(f"('{r}.{c}', {xs[c].size!r}::DOUBLE * {ys[r].size!r}::DOUBLE)" for r in range(20) for c in range(20))
    whole = f"({BOUNDS_L.x.size!r}::DOUBLE * {BOUNDS_L.y.size!r}::DOUBLE)"
    return (
        f"WITH tiles(tile_id, area) AS (VALUES {sides}), n AS (SELECT count(*) AS total FROM {_L}), r AS (SELECT tile_id, ceil(total * area / {whole})::BIGINT AS expected_rows FROM tiles, n), "
        "a AS (SELECT *, least(expected_rows, 2) AS one FROM r), b AS (SELECT *, one + least(expected_rows, 3 * one) AS two FROM a) "
        "SELECT tile_id, expected_rows, (two + least(expected_rows, 7 * two))::BIGINT AS cost FROM b"
    )


@_register("planner_costs", _costs_sql())
def _costs(spark: SparkSession, d: str) -> DataFrame:
    base = TiledIndex(lineitem(spark, d), L, CONFIG, "valinor")
    base.plan_layout(FLAGSHIP)
    p = base.planner
    return spark.createDataFrame([(t.id, p.expected_rows(t), p.cost(t, p.by_score)) for t in base.tiles.values()], "tile_id string, expected_rows long, cost long")


def _naive_sql() -> str:
    """Tiles by density (a fixed order of the layout), as long as the sum of costs is within the budget."""
    interest = policies.Interest(FLAGSHIP, CONFIG)
    line = sorted(_PLAIN.tiles(), key=lambda t: -interest.density(t.rect))
    order = ", ".join(f"('{t.id}', {i})" for i, t in enumerate(line))
    return (
        f"WITH costs AS ({_costs_sql()}), line(tile_id, place) AS (VALUES {order}), s AS (SELECT tile_id, sum(cost) OVER (ORDER BY place) AS spent FROM costs JOIN line USING (tile_id)) "
        "SELECT tile_id, 'l_linestatus,l_returnflag,l_linenumber' AS attrs FROM s WHERE spent <= 4000"
    )


@_register("naive_assignment", _naive_sql())
def _naive(spark: SparkSession, d: str) -> DataFrame:
    base = TiledIndex(lineitem(spark, d), L, CONFIG, "valinor")
    leaves = base.plan_layout(FLAGSHIP)
    return spark.createDataFrame([(t, ",".join(a)) for t, a in policies.policy("naive")(base.planner, leaves, 4000).items()], "tile_id string, attrs string")

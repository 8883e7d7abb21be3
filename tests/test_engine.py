import json
import math
import os
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tilewright import cli
from tilewright.operators import direct, grid, stats
from tilewright.operators.index import TiledIndex
from tilewright.plans import queries
from tilewright.plans.policies import POLICIES
from tilewright.plans.session import random_windows
from tilewright.plans.spec import DatasetSpec, IndexConfig, Rectangle, WindowQuery
from tilewright.sources import report, tables
from tilewright.streaming import refresh

EDGE = DatasetSpec("a", "b", ("c",), ("d",), columns=("a", "b", "c", "d"))


def near(got, want, keys):
    """Whether two metric frames agree, doubles within 1e-9."""
    rows = lambda df: {tuple(r[k] for k in keys): r.asDict() for r in df.collect()}
    g, w = rows(got), rows(want)
    assert g.keys() == w.keys()
    for k in g:
        for c, v in w[k].items():
            if isinstance(v, float):
                assert g[k][c] is not None and math.isclose(g[k][c], v, rel_tol=1e-7, abs_tol=1e-9), (k, c, g[k][c], v)
            elif v is None and g[k][c] is not None:
                assert abs(g[k][c]) < 1e6  # a ratio of two rounding errors
            else:
                assert g[k][c] == v, (k, c)


@pytest.fixture(scope="module")
def edge(spark, tmp_path_factory):
    p = tmp_path_factory.mktemp("csv") / "t.csv"
    p.write_text('1.5,2,A,3\nabc,2,A,3\n" 1.5 ",2,,\n"1.5",2,"x,y",NaN\n\n#c,1,1,1\n1.5,2\n0,2,A,5\n9,9,B,1\n3,3,B,7\n')
    return direct.prepare(tables.read_csv(spark, str(p), EDGE), EDGE)


def test_hand_made_rows(edge):
    q = WindowQuery(Rectangle.of(0, 5, 0, 5), {}, ("c",))
    got = {r["c"]: r for r in direct.answer(edge, EDGE, q).groups.collect()}
    assert got["A"]["n"] == 1 and got["B"]["n"] == 1 and math.isnan(got["x,y"]["sum0"])
    assert got["B"]["var_samp0"] is None and got["B"]["var_pop0"] == 0 and got["B"]["corr"] is None
    assert "N/A" not in got  # such rows have no measure; they are points all the same
    assert direct.answer(edge, EDGE, q).points.count() == 5
    assert direct.answer(edge, EDGE, replace(q, filters={"c": None})).points.count() == 2
    assert direct.answer(edge, EDGE, replace(q, filters={"c": "N/A"})).points.count() == 2
    assert direct.answer(edge, EDGE, replace(q, rect=Rectangle.of(50, 60, 0, 5))).total.count() == 0
    assert tables.bounds(edge, "x", "y").first()["x_max"] == 9
    assert tables.domain_sizes(edge, ["c"]).first()["c"] == 4
    assert tables.domains(edge, ["c"]) == {"c": ["A", "B", "N/A", "x,y"]}
    assert tables.bounds_rectangle(edge, "x", "y").contains(9, 9)


def test_pushdown(spark, small, tmp_path):
    rows = queries.lineitem(spark, small)
    rows.write.parquet(str(tmp_path / "p"))
    stored = spark.read.parquet(str(tmp_path / "p"))
    plan = direct.answer(stored, queries.L, queries.FLAGSHIP).groups._jdf.queryExecution().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "GreaterThan(x,20000.0)" in pushed and "EqualTo(l_linestatus,O)" in pushed
    assert "l_linenumber" not in plan[plan.index("ReadSchema") :].split("\n")[0]


@pytest.mark.parametrize("name", [n for n in POLICIES if n != "exhaustive"])
def test_index_state_never_changes_an_answer(spark, small, name):
    rows = queries.lineitem(spark, small).cache()
    index = TiledIndex(rows, queries.L, replace(queries.CONFIG, grid=6, threshold=40), name, 300, bins=4).build(queries.FLAGSHIP)
    with pytest.raises(RuntimeError):
        index.build(queries.FLAGSHIP)
    filters = [{}, {"l_linestatus": "O"}, {"l_linenumber": "3"}]
    for i, rect in enumerate(random_windows(Rectangle.of(900, 105000, 0, 51), 0.3, 3, seed=len(name))):
        q = WindowQuery(rect, filters[i], ("l_returnflag",), "l_tax" if i == 2 else None)
        want = direct.answer(rows, queries.L, q)
        for state in (index, index := index.adapt(q)):
            got = state.answer(q)
            near(got.groups, want.groups, ["l_returnflag"])
            near(got.total, want.total, [])
            assert sorted(map(tuple, got.points.collect())) == sorted(map(tuple, want.points.collect()))
    assert index.size()["rows"] == rows.count()
    assert index.dump().count() == len(index.tiles)


def test_adapting_learns(spark, small):
    index = TiledIndex(queries.lineitem(spark, small), queries.L, replace(queries.CONFIG, grid=8, threshold=50), "greedy", 0).build(queries.FLAGSHIP)
    before = index.plan(queries.FLAGSHIP)
    after = index.adapt(queries.FLAGSHIP)
    assert not before.states and before.unknown and after.plan(queries.FLAGSHIP).states
    assert after.plan(queries.FLAGSHIP).rows_scanned < before.rows_scanned
    assert after.size()["max_depth"] > index.size()["max_depth"]
    assert index.plan(queries.FLAGSHIP).rows_scanned == before.rows_scanned  # the old value is as it was
    assert queries.FLAGSHIP and after.adapt(WindowQuery(Rectangle.of(-9, -8, -9, -8))) is after


def test_builds_on_first_query(spark, small):
    rows = queries.lineitem(spark, small)
    index = TiledIndex(rows, replace(queries.L, bounds=None), replace(queries.CONFIG, grid=4), "full")
    near(index.answer(queries.FLAGSHIP).groups, direct.answer(rows, queries.L, queries.FLAGSHIP).groups, ["l_returnflag"])
    assert index.built and index.total_utility > 0
    size = index.size()
    assert size["cube_bytes"] > 0 and size["points_bytes"] > size["cube_bytes"] / 100
    one = next(t for t in index.tiles.values() if t.rows)
    kept = index.readout(one.id).collect()
    assert sum(r["rows"] for r in kept) == one.rows and all(r["n"] <= r["rows"] for r in kept)
    assert index.readout().select("tile_id").distinct().count() == sum(t.rows > 0 for t in index.tiles.values())
    paths = [df._tilewright_path.removeprefix("file:") for df in (index.clustered, index.cube)]
    assert all(os.path.isdir(p) for p in paths)
    index.close()
    assert not index.built and not any(os.path.exists(p) for p in paths)


def test_indexed_plan_has_one_scan_of_points_and_one_of_states(spark, small):
    index = TiledIndex(queries.lineitem(spark, small), queries.L, replace(queries.CONFIG, grid=8), "full").build(queries.FLAGSHIP)
    got = index.answer(queries.FLAGSHIP)
    for df in (got.groups, got.total):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") <= 2 and "NestedLoop" not in plan and "Join" not in plan
    assert index.rows_read(queries.FLAGSHIP) <= got.metrics["rows_scanned"]
    assert len(index.children("0")) == 0 and index.changes == {"split": 0, "expanded": 0}


def test_one_of_two_measures_from_states(spark, small):
    """States answer a chosen measure where no row of the tile has but one of the two."""
    df = spark.read.parquet(f"{small}/lineitem.parquet")
    for spoil in (False, True):
        rows = direct.prepare(df.withColumn("l_tax", F.when(F.lit(not spoil) | (F.col("l_orderkey") % 7 != 0), F.col("l_tax"))), queries.L)
        index = TiledIndex(rows, queries.L, replace(queries.CONFIG, grid=8), "full").build(queries.FLAGSHIP)
        for measure in ("l_tax", "l_discount"):
            q = replace(queries.FLAGSHIP, measure=measure)
            near(index.answer(q).groups, direct.answer(rows, queries.L, q).groups, ["l_returnflag"])
            assert bool(index.plan(q).states) != spoil


def test_empty_table(spark):
    rows = direct.prepare(spark.createDataFrame([], "a string, b string, c string, d string"), EDGE)
    q = WindowQuery(Rectangle.of(0, 1, 0, 1), {}, ("c",))
    assert TiledIndex(rows, EDGE, IndexConfig(grid=2)).answer(q).groups.count() == 0
    assert direct.answer(rows, EDGE, q).total.count() == 0


def test_merge_without_cancellation(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("g"), (F.rand(1) + 1e8).alias("m0"), F.rand(2).alias("m1")).cache()
    got = stats.metrics(stats.merge(stats.aggregate(df, ["g"]), []), []).first()
    want = stats.metrics(stats.aggregate(df, []), []).first()
    for c in ("n", "mean0", "var_pop0", "covar_pop", "corr", "slope"):
        assert math.isclose(got[c], want[c], rel_tol=1e-6), c


def test_synthetic(spark, tmp_path):
    t = tables.preset(spark, "synth50", rows=200)
    assert len(t.columns) == 50 and t.select("c10").distinct().count() <= 10
    r = t.first()
    assert len(r["c10"]) == 10 and 0 <= float(r["c0"]) < 1000 and len(r["c0"].partition(".")[2]) == 6
    assert tables.preset(spark, "synth10", 50).collect() == tables.preset(spark, "synth10", 50).collect()


def test_command_line(spark, tmp_path, capsys):
    data, log = str(tmp_path / "d"), str(tmp_path / "log")
    cli.main(["synth10", "--rows", "3000", "--out", data], spark)
    common = ["--csv", data, "--columns", "10", "--measureCol", "9", "--catCols", "2,3", "--groupBy", "2", "--bounds", "0:1000,0:1000", "--rect", "300:700,300:700", "--gridSize", "6"]
    rows = cli.main(["timeQueries", *common, "--seqCount", "3", "--maxFilters", "1", "--minFilters", "1", "--out", log, "--adapt"], spark)
    assert len(rows) == 3 and report.read(spark, "queries", log).count() == 3
    assert json.loads(rows[0]["result"])[0]["n"] > 0
    assert all(r["rows_read"] <= r["rows_scanned"] for r in rows)
    assert cli.main(["timeQueries", *common, "--seqCount", "1", "--catBudget", "0", "--adapt"], spark)[0]["expanded_nodes"] == 4
    for command, kind in (("timeInitialization", "initialization"), ("timeAssignmentTime", "assignment"), ("computeUtils", "utility")):
        cli.main([command, *common, "--catBudget", "0.0001", "--out", f"{log}-{kind}"], spark)
        assert report.read(spark, kind, f"{log}-{kind}").count() == 1
    dummy = [x for x in common if x not in ("--csv", data)]
    assert cli.main(["timeAssignmentTime", *dummy, "--objCount", "1000", "--initMode", "full"], spark)[0]["utility"] > 0
    assert cli.main(["findDomains", *common, "--sample", "500"], spark) == {"c2": 10, "c3": 10}
    lo, hi = cli.main(["findBounds", *common], spark).split(",")[0].split(":")
    assert 0 <= float(lo) < 5 and 995 < float(hi) < 1000
    with pytest.raises(ValueError):
        report.append(spark, "utility", [{"nonsense": 1}], log)


def test_streamed_cube_equals_direct(spark, small, tmp_path):
    source = spark.read.parquet(f"{small}/lineitem.parquet")
    source.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = refresh.stream_cube(stream, queries.L, queries._PLAIN, str(tmp_path / "cube"), str(tmp_path / "check"))
    q.awaitTermination()
    want = stats.metrics(stats.aggregate(queries.lineitem(spark, small), ["l_returnflag"]), ["l_returnflag"])
    near(refresh.read_cube(spark, str(tmp_path / "cube"), ["l_returnflag"]), want, ["l_returnflag"])
    refresh.compact(spark, str(tmp_path / "cube"), queries.L, str(tmp_path / "small"))
    near(refresh.read_cube(spark, str(tmp_path / "small"), ["l_returnflag"]), want, ["l_returnflag"])


def test_split_points_find_their_quarter(spark, small):
    placed = grid.assign(queries.lineitem(spark, small), queries._QUAD)
    known = {t.id: t for t in queries._QUAD.tiles()}
    for r in placed.where(F.col("tile_id").contains("q")).select("tile_id", "x", "y").collect():
        assert known[r["tile_id"]].rect.contains(r["x"], r["y"])

"""Command line: `python -m tilewright.cli COMMAND ...`."""

from __future__ import annotations

import argparse
import json
import math
import time

from pyspark.sql import SparkSession

from .operators import direct, stats
from .operators.index import TiledIndex
from .plans import policies, session
from .plans.catalog import layout_for, with_attrs
from .plans.policies import Attr, Interest, Planner, budget_for
from .plans.spec import DatasetSpec, IndexConfig, WindowQuery, format_query, parse_filters, parse_rectangle
from .sources import report, tables
from .sources.storage import delete, stored_bytes, written

#: Bytes of a state where no table is there to measure: ten numbers, an extent, a path and its keys.
STATE_BYTES = 200
SAMPLE_ROWS = 10_000


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tilewright")
    p.add_argument("command", choices=["timeQueries", "timeInitialization", "timeAssignmentTime", "computeUtils", "findBounds", "findDomains", "synth10", "synth50"])
    p.add_argument("--csv", help="the table: a delimited file")
    p.add_argument("--out", help="where a log or a table goes")
    p.add_argument("--columns", type=int, help="how many columns the file has")
    p.add_argument("--delimiter", default=",")
    p.add_argument("--header", action="store_true")
    p.add_argument("--xCol", type=int, default=0)
    p.add_argument("--yCol", type=int, default=1)
    p.add_argument("--measureCol", type=int)
    p.add_argument("--measureCol2", type=int)
    p.add_argument("--catCols", type=lambda s: [int(c) for c in s.split(",")], default=[])
    p.add_argument("--groupBy", type=lambda s: [int(c) for c in s.split(",")], default=[])
    p.add_argument("--filters", type=parse_filters, default={})
    p.add_argument("--bounds", type=parse_rectangle)
    p.add_argument("--rect", type=parse_rectangle)
    p.add_argument("--initMode", default="binn")
    p.add_argument("--sort", default="asc")
    p.add_argument("--binCount", type=int, default=100)
    p.add_argument("--catBudget", type=float, default=math.inf, help="GB")
    p.add_argument("--objCount", type=int)
    p.add_argument("--seqCount", type=int, default=10)
    p.add_argument("--minShift", type=int, default=10)
    p.add_argument("--maxShift", type=int, default=10)
    p.add_argument("--minFilters", type=int, default=0)
    p.add_argument("--maxFilters", type=int, default=0)
    p.add_argument("--zoomFactor", type=float, default=0.0)
    p.add_argument("--gridSize", type=int, default=100)
    p.add_argument("--cardinality", type=int, default=10)
    p.add_argument("--rows", type=int, help="rows of a synthetic table")
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--sample", type=int, help="take domains from so many rows")
    p.add_argument("--directions", default="synth", choices=list(session.DIRECTION_WEIGHTS))
    p.add_argument("--adapt", action="store_true", help="adapt the index after each query")
    return p


def _spec(a: argparse.Namespace) -> DatasetSpec:
    used = [a.xCol, a.yCol, *a.catCols, *[c for c in (a.measureCol, a.measureCol2) if c is not None]]
    n = a.columns or max(used) + 1
    names = tuple(f"c{i}" for i in range(n))
    measures = tuple(f"c{c}" for c in (a.measureCol, a.measureCol2) if c is not None)
    return DatasetSpec(f"c{a.xCol}", f"c{a.yCol}", tuple(f"c{c}" for c in a.catCols), measures, a.bounds, a.objCount, names, a.delimiter, a.header)


def _first(a: argparse.Namespace) -> WindowQuery:
    if a.rect is None:
        raise SystemExit("--rect is needed")
    return WindowQuery(a.rect, {f"c{k}": v for k, v in a.filters.items()}, tuple(f"c{c}" for c in a.groupBy))


def _run_columns(a: argparse.Namespace, budget: float) -> dict:
    finite = math.isfinite(budget)
    return {
        "dataset": a.csv or "",
        "categories": len(a.catCols),
        "mode": a.initMode,
        "budget_gb": a.catBudget if finite else None,
        "budget_states": int(budget) if finite else None,
        "bins": a.binCount,
    }


def _index(spark: SparkSession, a: argparse.Namespace, budget: float) -> TiledIndex:
    spec = _spec(a)
    rows = direct.prepare(tables.read_csv(spark, a.csv, spec), spec)
    return TiledIndex(rows, spec, IndexConfig(grid=a.gridSize), a.initMode, budget, a.binCount, a.sort, a.seed)


def state_bytes(spark: SparkSession, a: argparse.Namespace) -> float:
    """Bytes of a stored state, measured on the states of some rows of the table."""
    spec = _spec(a)
    if not a.csv or not spec.cats:
        return STATE_BYTES
    rows = direct.prepare(tables.read_csv(spark, a.csv, spec).limit(SAMPLE_ROWS), spec)
    states = written(stats.aggregate(rows, list(spec.cats)), "state_sample")
    n, size = states.count(), stored_bytes(states)
    delete(states)
    return max(size / n, 1.0) if n else STATE_BYTES


def _planner(spark: SparkSession, a: argparse.Namespace, config: IndexConfig) -> tuple[Planner, list]:
    """Without a table: dummy domains of one cardinality."""
    if a.csv:
        index = _index(spark, a, math.inf)
        tiles = index.plan_layout(_first(a))
        return index.planner, tiles
    interest = Interest(_first(a), config)
    attrs = [Attr(f"c{c}", a.cardinality) for c in a.catCols]
    planner = Planner(interest, attrs, a.bounds, a.objCount or 0, a.sort, a.binCount, a.seed)
    return planner, layout_for(a.bounds, config, interest.probability).tiles()


def time_queries(spark: SparkSession, a: argparse.Namespace, budget: float) -> list[dict]:
    index, q0, log = _index(spark, a, budget), _first(a), []
    queries = session.generate(
        q0, a.seqCount, index.spec, tables.domains(index.rows if a.sample is None else index.rows.limit(a.sample), list(index.spec.cats)), a.minShift, a.maxShift, a.minFilters, a.maxFilters, a.zoomFactor, a.directions, seed=a.seed
    )
    for i, q in enumerate(queries):
        began = time.time()
        answer = index.answer(q, q0)
        result = [r.asDict() for r in answer.groups.collect()]  # groups of one window
        seconds, c, now = time.time() - began, answer.metrics, index
        if a.adapt:
            index = index.adapt(q)
        grown = {"split": 0, "expanded": 0} if index is now else index.changes
        log.append(
            _run_columns(a, budget)
            | {"session": a.seed, "query_no": i, "query": format_query(q), "utility": now.total_utility, "states": now.cube.count(), "leaf_tiles": c["tiles"]}
            | {"overlapped_tiles": c["overlapped"], "contained_tiles": c["contained"], "expanded_nodes": grown["expanded"], "split_tiles": grown["split"], "rows_scanned": c["rows_scanned"], "rows_read": now.rows_read(q)}
            | {"seconds": seconds, "result": json.dumps(result)}
        )
    if a.out:
        report.append(spark, "queries", log, a.out)
    return log


def time_initialization(spark: SparkSession, a: argparse.Namespace, budget: float) -> list[dict]:
    began = time.time()
    index = _index(spark, a, budget).build(_first(a))
    seconds, size = time.time() - began, index.size()
    log = [_run_columns(a, budget) | {"sort": a.sort, "seconds": seconds, "utility": size["utility"], "leaf_tiles": size["leaf_tiles"], "states": size["states"], "cube_bytes": size["cube_bytes"], "points_bytes": size["points_bytes"]}]
    if a.out:
        report.append(spark, "initialization", log, a.out)
    return log


def time_assignment(spark: SparkSession, a: argparse.Namespace, budget: float) -> list[dict]:
    planner, tiles = _planner(spark, a, IndexConfig(grid=a.gridSize, subtile_ratio=0.0))
    began = time.time()
    assigned = policies.policy(a.initMode)(planner, tiles, budget)
    seconds = time.time() - began
    tiles = with_attrs(tiles, assigned)
    log = [_run_columns(a, budget) | {"grid": a.gridSize, "cardinality": a.cardinality, "seconds": seconds, "utility": planner.total_utility(tiles), "leaf_tiles": len(tiles)}]
    if a.out:
        report.append(spark, "assignment", log, a.out)
    return log


def compute_utilities(spark: SparkSession, a: argparse.Namespace, budget: float) -> list[dict]:
    planner, tiles = _planner(spark, a, IndexConfig(grid=a.gridSize))
    tiles = with_attrs(tiles, policies.policy(a.initMode)(planner, tiles, budget))
    log = [_run_columns(a, budget) | {"utility": planner.total_utility(tiles), "leaf_tiles": len(tiles)}]
    if a.out:
        report.append(spark, "utility", log, a.out)
    return log


def main(argv: list[str] | None = None, spark: SparkSession | None = None):
    a = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("tilewright").getOrCreate()
    budget = math.inf if math.isinf(a.catBudget) else budget_for(a.catBudget, state_bytes(spark, a))
    if a.command in tables.PRESETS:
        tables.write_csv(tables.preset(spark, a.command, a.rows, a.seed), a.out)
        return a.out
    if a.command == "findDomains":
        spec = _spec(a)
        sizes = tables.domain_sizes(tables.read_csv(spark, a.csv, spec), list(spec.cats), a.sample).first().asDict()
        print(json.dumps(sizes))
        return sizes
    if a.command == "findBounds":
        spec = _spec(a)
        r = tables.bounds(tables.read_csv(spark, a.csv, spec), spec.x, spec.y).first()
        text = f"{r['x_min']}:{r['x_max']},{r['y_min']}:{r['y_max']}"
        print(text)
        return text
    run = {"timeQueries": time_queries, "timeInitialization": time_initialization, "timeAssignmentTime": time_assignment, "computeUtils": compute_utilities}
    log = run[a.command](spark, a, budget)
    for row in log:
        print(json.dumps({k: v for k, v in row.items() if k != "result"}))
    return log


if __name__ == "__main__":
    main()

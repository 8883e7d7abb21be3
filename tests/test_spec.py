import math

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tilewright.plans.catalog import Tile, cut, layout_for, quarters, splittable
from tilewright.plans.policies import POLICIES, Attr, Interest, Planner, budget_for, exhaustive, policy
from tilewright.plans.session import directions, generate, pan, random_windows, step_with_overlap, zoom_in, zoom_out
from tilewright.plans.spec import (
    DatasetSpec,
    IndexConfig,
    Range,
    Rectangle,
    WindowQuery,
    format_query,
    parse_filters,
    parse_query,
    parse_range,
    parse_rectangle,
)

Q0 = WindowQuery(Rectangle.of(544, 574, 323, 353), {"a": "1"}, ("b",))
SQUARE = Rectangle.of(0, 1000, 0, 1000)


def test_open_window_excludes_its_edges():
    r = Rectangle.of(0, 10, 0, 10)
    assert r.contains(5, 5) and not r.contains(0, 5) and not r.contains(5, 10)
    assert r.widened().contains(0, 10)


def test_rectangles_that_touch_do_not_intersect():
    assert not Rectangle.of(0, 1, 0, 1).intersects(Rectangle.of(1, 2, 0, 1))
    assert Range(0, 1, True, True).intersects(Range(1, 2, True))
    assert Rectangle.of(0, 4, 0, 4).encloses(Rectangle.of(0, 4, 1, 2))
    assert not Rectangle.of(0, 4, 0, 4).encloses(Rectangle(Range(0, 4, True), Range(1, 2)))
    assert Rectangle.of(0, 4, 0, 4).distance(Rectangle.of(3, 7, 4, 8)) == 5


def test_parsers():
    assert parse_rectangle("0:1000,-5:2.5") == Rectangle.of(0, 1000, -5, 2.5)
    assert parse_range("1:2") == Range(1, 2)
    assert parse_filters("3:a,4:N/A") == {3: "a", 4: "N/A"}
    with pytest.raises(ValueError):
        parse_query("Query{}")
    assert IndexConfig.from_properties("#x\nGRID_SIZE=20\nTHRESHOLD = 7\nOTHER=1\n") == IndexConfig(grid=20, threshold=7)


@pytest.mark.parametrize(
    "line",
    [
        "Query{rect=(10.0..20.5),(-3.25..40.0), categoricalFilters={3=1000000000, 4=7000000000}, groupByCols=[2], measureCol=9}",
        "Query{rect=(-73.99..-73.975),(40.7..40.73264), categoricalFilters={0=ABC, 8=N/A}, groupByCols=[3], measureCol=16}",
        "Query{rect=(0.0..1.0),(0.0..1.0), categoricalFilters={}, groupByCols=[], measureCol=null}",
    ],
)
def test_logged_queries_read_back(line):
    assert format_query(parse_query(line)) == line


@given(st.tuples(*[st.floats(-1e6, 1e6, width=32)] * 4), st.dictionaries(st.integers(0, 50), st.text("abc/N019", min_size=1), max_size=3))
def test_query_text_round_trip(w, filters):
    q = WindowQuery(Rectangle.of(*w), filters, (2,), 9)
    assert parse_query(format_query(q)) == q


def test_undeclared_columns_are_errors():
    spec = DatasetSpec("x", "y", ("a", "b"), ("m",))
    for q in (WindowQuery(SQUARE, {"c": "1"}), WindowQuery(SQUARE, {}, ("c",)), WindowQuery(SQUARE, measure="k")):
        with pytest.raises(ValueError):
            q.validate(spec)
    assert WindowQuery(SQUARE, None, None).attributes == set()
    with pytest.raises(ValueError):
        DatasetSpec("x", "y", (), ("a", "b", "c"))


@pytest.mark.parametrize(
    "bounds, rect, grid, leaves",
    [
        (SQUARE, Q0.rect, 100, 11263),
        (Rectangle.of(900, 105000, 0, 51), Rectangle.of(20000, 60000, 10, 30), 20, 400),
        (Rectangle.of(900, 105000, 0, 51), Rectangle.of(40000, 46000, 20, 24), 20, 418),
    ],
)
def test_leaf_tile_counts(bounds, rect, grid, leaves):
    config = IndexConfig(grid=grid)
    assert len(layout_for(bounds, config, Interest(WindowQuery(rect), config).probability).tiles()) == leaves


def test_cuts_cover_the_range_once():
    parts = cut(Range(0, 51), 20)
    assert parts[0].lo == 0 and parts[-1].hi == 51 and parts[-1].hi_closed
    assert all(a.hi == b.lo for a, b in zip(parts, parts[1:]))
    for v in (0.0, 2.55, 51.0, 17.3):
        assert sum(p.contains(v) for p in parts) == 1


def test_quarters_hold_the_middle_low():
    tile = Tile("0.0", Rectangle(Range(0, 4, True), Range(0, 4, True)))
    kids = quarters(tile)
    assert [k.rect.contains(2, 2) for k in kids] == [True, False, False, False]
    assert [k.rect.contains(3, 1) for k in kids] == [False, True, False, False]
    assert not splittable(Tile("t", Rectangle.of(1, math.nextafter(1, 2), 0, 1)))


def _planner(n=6, **kw):
    config = IndexConfig(grid=2)
    attrs = [Attr("a", 3), Attr("b", 5), Attr("c", 2)]
    p = Planner(Interest(Q0, config), attrs, SQUARE, 600, **kw)
    xs = cut(SQUARE.x, n)
    return p, [Tile(f"0.{i}", Rectangle(x, SQUARE.y)) for i, x in enumerate(xs)]


def test_interest_and_costs():
    p, tiles = _planner()
    assert p.interest.score("a") == 0.5 and p.interest.score("b") == 0.4 and p.interest.score("c") == 0.1
    assert [a.name for a in p.by_score] == ["a", "b", "c"]
    assert p.tree_utility([]) == 0 and p.tree_utility(p.attrs) == pytest.approx(1)
    assert p.expected_rows(tiles[0]) in (100, 101)
    # 3, then 5 * 3 on top, then 2 * 18
    assert p.cost(tiles[0], p.attrs) == 3 + 15 + 36
    assert 0.99 < Interest(Q0).probability(Rectangle.of(-1e6, 1e6, -1e6, 1e6)) <= 1


@pytest.mark.parametrize("sort", ["asc", "desc"])
@pytest.mark.parametrize("budget", [0, 20, 90, 10_000])
def test_policies_keep_to_the_budget_and_to_the_optimum(sort, budget):
    p, tiles = _planner(sort=sort)
    named = {a.name: a for a in p.attrs}
    worth = lambda got: sum(p.utility(t, [named[x] for x in got.get(t.id, ())]) for t in tiles)
    best = worth(exhaustive(p, tiles, budget))
    for name, f in POLICIES.items():
        got = f(p, tiles, budget)
        spent = sum(p.cost(t, [named[x] for x in got[t.id]]) for t in tiles if t.id in got)
        if name != "full":
            assert spent <= budget
            if name not in ("optimized", "random"):  # these may order or choose attributes otherwise
                assert worth(got) <= best + 1e-12
    assert policy("BINN") is policy("binn")
    assert POLICIES["valinor"](p, tiles, budget) == {}
    assert len(POLICIES["full"](p, tiles, 0)) == len(tiles)
    with pytest.raises(ValueError):
        policy("none such")


@pytest.mark.parametrize("budget", [0, 5, 60, 130, 10_000])
def test_policies_equal_plain_versions(budget):
    """naive and random, step by step as they are defined; greedy, optimized and binn as loops over sorted lists."""
    import random

    p, tiles = _planner(sort="asc", bins=3)
    line = sorted(tiles, key=lambda t: p.interest.probability(t.rect) / t.rect.area, reverse=True)

    def cost(t, attrs):
        rows, total = math.ceil(600 * t.rect.area / SQUARE.area), 0
        for x in attrs:
            total += min(rows, x.cardinality * max(total, 1))
        return total

    left, want = budget, {}
    for t in line:
        if cost(t, p.by_score) > left:
            break
        left -= cost(t, p.by_score)
        want[t.id] = ("a", "b", "c")
    assert POLICIES["naive"](p, tiles, budget) == want
    left, want, rng = budget, {}, random.Random(p.seed)
    for t in line:
        if left > 0:
            some = rng.sample(p.attrs, rng.randint(1, 3))
            if cost(t, some) <= left:
                left -= cost(t, some)
                want[t.id] = tuple(x.name for x in sorted(some, key=lambda x: x.cardinality))
    assert POLICIES["random"](p, tiles, budget) == want
    worth = {1: 0.5, 2: 0.9, 3: 1.0}
    left, want = budget, {}
    for t, n in sorted(((t, n) for t in tiles for n in (1, 2, 3)), key=lambda o: -p.interest.probability(o[0].rect) * worth[o[1]]):
        own = sorted(p.by_score[:n], key=lambda x: x.cardinality)
        if t.id not in want and cost(t, own) <= left:
            left -= cost(t, own)
            want[t.id] = tuple(x.name for x in own)
    assert POLICIES["greedy"](p, tiles, budget) == want
    left, want = budget, {}
    for i in range(0, 6, 2):
        for n in (3, 2, 1):
            own = sorted(p.by_score[:n], key=lambda x: x.cardinality)
            if sum(cost(t, own) for t in line[i : i + 2]) <= left:
                left -= sum(cost(t, own) for t in line[i : i + 2])
                want |= {t.id: tuple(x.name for x in own) for t in line[i : i + 2]}
                break
    assert POLICIES["binn"](p, tiles, budget) == want


def test_random_policy_and_budget():
    p, tiles = _planner()
    assert POLICIES["random"](p, tiles, 1000) == POLICIES["random"](p, tiles, 1000)
    assert budget_for(2, 200) == 10_000_000
    with pytest.raises(ValueError):
        exhaustive(p, tiles * 2, 10)
    with pytest.raises(ValueError):
        _planner(sort="sideways")


def test_sessions():
    spec = DatasetSpec("x", "y", ("a", "b", "c"), ("m",))
    domains = {k: ["1", "2"] for k in spec.cats}
    one = generate(Q0, 30, spec, domains, 10, 20, 1, 2, 1.5, seed=3)
    assert one == generate(Q0, 30, spec, domains, 10, 20, 1, 2, 1.5, seed=3)
    assert one[0] == Q0 and len(one) == 30 and all(1 <= len(q.filters) <= 2 and "b" not in q.filters for q in one[1:])
    back = zoom_out(zoom_in(Q0.rect, 2), 2)
    assert back.x.lo == pytest.approx(Q0.rect.x.lo) and back.y.hi == pytest.approx(Q0.rect.y.hi)
    assert pan(Q0.rect, 10, "NE") == Rectangle.of(547, 577, 326, 356)
    assert step_with_overlap(Q0.rect, 0.9, "W").x.lo == pytest.approx(541)
    assert all(len(directions(50, w, 1)) == 50 for w in ("taxi", "network", "even"))
    assert directions(400, "network", 2).count("W") > 2 * directions(400, "network", 2).count("E")
    assert set(directions(200)) <= {"N", "S", "E", "W", "NE", "NW", "SE", "SW"}
    with pytest.raises(ValueError):
        generate(Q0, 3, spec, domains, max_filters=3)
    for r in random_windows(SQUARE, 0.01, 20):
        assert SQUARE.encloses(r) or (r.x.lo >= 0 and r.x.hi <= 1000.001)
        assert r.area == pytest.approx(10_000, rel=1e-3)

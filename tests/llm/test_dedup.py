import random

import brute
import numpy as np
import pytest

from tilewright.llm import minhash_dedup, substring_dedup


def test_near_duplicates_equal_brute_force(documents, pairs, rows):
    assert rows(minhash_dedup.classes(documents)) == sorted(brute.op2(pairs(documents)), key=str)


def test_family_about_a_base_that_is_not_the_smallest(spark, rows):
    """Copies are similar to the base but not to each other: stars about a copy lose links, the prefix join finds them."""
    rng, words = random.Random(3), [f"w{i}" for i in range(5000)]
    base = [rng.choice(words) for _ in range(200)]
    data = []
    for i in range(120):
        copy = list(base)
        for _ in range(rng.choice([2, 4, 5, 6, 8])):
            copy[rng.randrange(200)] = rng.choice(words)
        data.append((i, " ".join(copy)))
    data += [(77777, " ".join(base)), *[(5000 + i, x) for i, x in enumerate(["a b", "a B", "a b c d e", "A b c d e f", None, "", " \n", "a b c d e"])]]
    got = rows(minhash_dedup.classes(spark.createDataFrame(data, "doc_id long, text string")))
    assert got == sorted(brute.op2(data), key=str)


def test_rest_join_finds_all_links(spark, rows):
    """The exact join alone, every set its own component."""
    rng = random.Random(8)
    sets = {}
    for family in range(12):
        base = rng.sample(range(10**9), 60)
        for copy in range(8):
            s = set(base) - set(rng.sample(base, copy)) | set(rng.sample(range(10**9), copy))
            sets[family * 8 + copy] = np.array(sorted(s), np.uint64)
    df = spark.createDataFrame([(k, v.tobytes()) for k, v in sets.items()], "rep long, shingles binary")
    members = df.selectExpr("rep", "rep as component")
    want = []
    for a in sets:
        for b in sets:
            n = len(np.intersect1d(sets[a], sets[b]))
            if a < b and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                want.append((a, b))
    assert rows(minhash_dedup._rest(members, df, "bigint")) == sorted(want, key=str)


def test_signature():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 40, 3000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        assert len(minhash_dedup.signature(a)) == minhash_dedup.BINS and set(minhash_dedup.signature(a)) <= set(a)
    estimates = []
    for _ in range(60):
        a = rng.integers(0, 2**63, 40).astype(np.uint64)
        b = np.concatenate([a[:34], rng.integers(0, 2**63, 6).astype(np.uint64)])
        estimates.append((minhash_dedup.signature(np.unique(a)) == minhash_dedup.signature(np.unique(b))).mean())
    assert abs(np.mean(estimates) - 34 / 46) < 0.03


def test_odd_near_duplicates(odd, unnamed, nothing, pairs, rows):
    got = rows(minhash_dedup.classes(odd))
    want = {r[0]: r for r in brute.op2(dict(pairs(odd)).items())}
    assert got == sorted((want[d] for d, _ in pairs(odd)), key=str)
    # null ids sort last, and each such row is a document
    named = [(10**9 + i if d is None else d, t) for i, (d, t) in enumerate(pairs(unnamed))]
    want = {r[0]: r for r in brute.op2(dict(named).items())}
    hidden = lambda x: None if x >= 10**9 else x
    want = [(hidden(d), want[d][1], hidden(want[d][2]), not want[d][1] or want[d][2] >= 10**9 or want[d][3]) for d, _ in named]
    assert rows(minhash_dedup.classes(unnamed)) == sorted(want, key=str)
    assert rows(minhash_dedup.classes(nothing)) == []
    assert minhash_dedup.keep_first(odd).columns == odd.columns


def test_rows_follow_their_own_text(spark, rows):
    """Repeated ids with different texts, null ids, and rows that repeat in full: nothing is lost, one of each class stays."""
    rng = random.Random(12)
    a, b, c = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(3))
    near = a.split()
    near[50] = "other"
    near = " ".join(near)
    data = [(3, a), (5, a), (5, b), (5, b), (7, near), (None, a), (None, c), (None, c), (9, None), (9, ""), (3, near)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = rows(minhash_dedup.classes(df), "doc_id", "component_id", "kept")
    want = [(3, 3, True), (5, 3, False), (5, 5, True), (5, 5, True), (7, 3, False), (None, 3, False), (None, None, True), (None, None, True), (9, 9, True), (9, 9, True), (3, 3, True)]
    assert got == sorted(want, key=str)
    kept = rows(minhash_dedup.keep_first(df))
    assert [r for r in kept if r[0] != 3] == sorted([(5, b), (9, ""), (9, None), (None, c)], key=str)
    assert [r[0] for r in kept].count(3) == 1 and len(kept) == 5


def test_substrings_equal_brute_force(documents, pairs, rows):
    got = substring_dedup.remove_repeats(documents).cache()
    assert rows(got, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.op6(pairs(documents)), key=str)
    assert all(brute.sha(r["kept_text"]) == r["kept_sha256"] for r in got.collect())


def test_odd_substrings(spark, odd, unnamed, nothing, pairs, rows):
    columns = ("doc_id", "n_words", "n_removed", "kept_sha256")
    assert rows(substring_dedup.remove_repeats(odd), *columns) == sorted(brute.op6(pairs(odd)), key=str)
    lookup = substring_dedup.remove_repeats(odd, with_text=False, filtered=0)
    assert lookup.columns == list(columns) and rows(lookup) == sorted(brute.op6(pairs(odd)), key=str)
    last = [(10**9 if d is None else d, t) for d, t in pairs(unnamed)]
    want = sorted((None if r[0] == 10**9 else r[0], *r[1:]) for r in []) or [(None if r[0] == 10**9 else r[0], *r[1:]) for r in brute.op6(last)]
    assert rows(substring_dedup.remove_repeats(unnamed), *columns) == sorted(want, key=str)
    assert rows(substring_dedup.remove_repeats(nothing)) == []
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    data = [(1, a), (2, a), (2, b), (3, b + " " + a), (4, None), (5, ""), (6, "a b"), (7, a[:60]), (8, "x " * 200), (9, "x " * 50), (9, "x " * 50)]
    got = rows(substring_dedup.remove_repeats(spark.createDataFrame(data, "doc_id long, text string")), *columns)
    assert got == sorted(brute.op6(data), key=str)


def test_spans_and_paths_are_real(spark, rows):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    df = spark.createDataFrame([(1, a + " " + b), (2, "z " + a), (3, b)], "doc_id long, text string")
    spans, copies, paths = substring_dedup.repeated_spans(df)
    assert rows(spans, "id", "start", "length", "src", "src_start") == [(2, 1, 28, 1, 0), (3, 0, 28, 1, 40)]
    assert copies.count() == 0 and rows(spans, "path") == [(0,), (40,)]
    assert rows(paths) == [(1, 0, 28), (1, 40, 28)]


@pytest.mark.parametrize("n", [0, 1, 5])
def test_components(spark, rows, n):
    from tilewright.llm._components import components

    edges = [(i, i + 1) for i in range(n * 7)] + [(100 + i, 100) for i in range(1, n)] + [(300, 300)]
    got = rows(components(spark.createDataFrame(edges, "a long, b long")))
    want = [(i, 0) for i in range(n * 7 + 1)] * (n > 0) + [(100 + i, 100) for i in range(n)] * (n > 1)
    assert got == sorted(want, key=str)

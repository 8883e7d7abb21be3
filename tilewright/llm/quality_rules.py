"""Quality rules: base rules, then robust multivariate outliers by language and source.

Every text becomes a vector of transformed statistics. Per (language, source) the
minimum-covariance-determinant estimate of its centre and scatter is found by C-steps: keep the half of the documents with
the smallest Mahalanobis distances, re-estimate, repeat until the half no longer changes. There are 25 starts: medians with median deviations,
and 24 seeded sets of six documents; the least determinant wins. Documents are dealt to pieces of about 2,000 by a hash of their id, and
a group of one piece is estimated in one go. For larger groups the two best pieces' estimates go on with C-steps over all documents
of the group, each step one pass over packs of vectors that leaves sums by class of distance, until no determinant moves by a hundredth (ten steps at most): no task holds more than a piece. A document whose squared distance
exceeds the cut-off is rejected.

Every group of more than six documents has its own estimate; the others of a language are one group together. An estimate of n documents is
averaged with that of its language by n to 30, and a language's with that of all: small groups lean on larger ones
by degrees. A language's estimate is its groups' centres and scatters, pooled. Scatter never falls below a floor per statistic, because
most clean texts have exactly zero symbols, repeated lines and repeated words; determinants are of the floored scatter.

Defined results: a null or empty text has no words and fails the base rules. Null languages
and sources are values like any other. Null ids spread over pieces by their place in the table. Each input row gives one row, repeated rows included. Without a group of
more than six documents, not even of all small ones of a language, the method rejects nothing. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _text
from ._store import materialize, small

SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
#: The statistics, their transforms, and the least standard deviation of each. Where scatter is at its floor, seven times the
#: floor rejects by itself: texts 33 times as long as the centre's, 49% repeated lines, 40% repeated words (base rules take those above 50%).
STATISTICS = {
    "s_length": ("ln(1 + n_words)", 0.5),
    "s_word": ("ln(word_chars / n_words)", 0.12),
    "s_symbols": ("sqrt(n_symbols / n_words)", 0.06),
    "s_lines": ("sqrt(n_dup_lines / greatest(n_lines, 1))", 0.1),
    "s_repeats": ("sqrt(n_repeat_words / n_words)", 0.09),
}
#: Squared distance beyond which a document is rejected: seven deviations, far out for five Gaussian statistics (0.9999: 25.7).
CUTOFF = 49.0
#: Documents of a piece, random starts, most C-steps, and the documents that a parent's estimate counts for.
PIECE, STARTS, STEPS, PRIOR = 2_000, 24, 30, 30
#: Steps over whole large groups, which begin near their end: at most so many, and until no determinant moves by more than this share.
WHOLE_STEPS, STILL = 10, 0.01
#: The scatter of the nearest half of five Gaussian statistics times this is their scatter: 0.5 / P(chi2_7 <= median of chi2_5).
CONSISTENCY = 1.913
#: Distances are ranked in classes, 64 to a factor of e. Rows of large groups are stored in packs of so many.
CLASSES, PACK = 64, 128


def _statistics(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for t in _text.split_texts(batch.column(1)):
            w = _text.words_of(t, _text.NOT_SPACE)
            n = t.hi - t.lo
            points = np.concatenate([[0], np.cumsum((t.data & 0xC0) != 0x80)])
            chars = np.concatenate([[0], np.cumsum(points[w.end] - points[w.start])])
            symbols = np.concatenate([[0], np.cumsum(SYMBOLS[t.data])])
            dup, lines = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for i in range(n):
                seen = set()
                for line in t.text(i).split(b"\n"):
                    if line.strip(b" \t\n\x0b\x0c\r"):
                        lines[i] += 1
                        dup[i] += line in seen
                        seen.add(line)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c).slice(t.lo, n) for c in (0, 2, 3)],
                    *[pa.array(x, pa.int64()) for x in (w.counts, np.diff(chars[w.first]), np.diff(symbols[t.offsets]), dup, lines, _repeats(w))],
                ],
                [name, "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words"],
            )


def _repeats(w: _text.Words) -> np.ndarray:
    """Per text, the words in 3-word windows that it has twice or more."""
    total = len(w.start)
    if not total:
        return np.zeros(len(w.counts), np.int64)
    g = _text.grams(w.hashes(), 3)
    owner = np.repeat(np.arange(len(w.counts)), w.counts)
    at = np.flatnonzero(w.left() >= 3)
    key = _text.mix(g[at] ^ (owner[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(key, kind="stable")
    k = key[order]
    twin = np.zeros(len(k), bool)
    twin[1:] = k[1:] == k[:-1]
    twin[:-1] |= twin[1:]
    hit = np.zeros(total + 2, bool)
    for j in range(3):
        hit[at[order[twin]] + j] = True
    sums = np.concatenate([[0], np.cumsum(hit[:total])])
    return np.diff(sums[w.first])


def statistics(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per document row: id, lang, source, the counts, and the transformed statistics (null without words)."""
    kind = documents.schema[id_col].dataType.simpleString()
    docs = documents.select(F.col(id_col), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"))
    counts = ", ".join(f"{c} long" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words"))
    got = docs.mapInArrow(lambda batches, name=id_col: _statistics(batches, name), f"`{id_col}` {kind}, lang string, source string, {counts}")
    return got.select("*", *[F.expr(f"case when n_words > 0 then {e} end").alias(c) for c, (e, _) in STATISTICS.items()])


_NAMES = list(STATISTICS)
_P, _FLOOR = len(_NAMES), np.array([f for _, f in STATISTICS.values()])
_UPPER = np.triu_indices(_P)
_MOMENTS = [f"m{i}" for i in range(_P + len(_UPPER[0]))]
_GROUP = "struct<lang:string,source:string,rest:boolean>"
_ESTIMATE = f"g {_GROUP}, start int, n long, centre array<double>, scatter array<double>, score double"


def _inverse(scatter: np.ndarray) -> tuple[np.ndarray, float]:
    """(inverse, logarithm of the determinant) of a scatter in units of the floors, none of its eigenvalues below one."""
    value, vector = np.linalg.eigh(scatter)
    value = np.maximum(value, 1.0)
    return (vector / value) @ vector.T, float(np.log(value).sum())


def mcd(x: np.ndarray, starts: int = STARTS, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, float]:
    """(centre, scatter, logarithm of its determinant) of rows in units of the floors, whatever their order."""
    n = len(x)
    x = x[np.lexsort(x.T[::-1])]
    half = (n + _P + 1) // 2
    middle = np.median(x, axis=0)
    begin = [(middle, np.diag((1.4826 * np.median(abs(x - middle), axis=0)) ** 2))]
    rng = np.random.default_rng(0)
    for _ in range(starts):
        few = x[rng.choice(n, _P + 1, replace=False)]
        begin.append((few.mean(axis=0), np.cov(few.T, bias=True)))
    best = None
    for centre, scatter in begin:
        before = None
        for _ in range(steps):
            away = x - centre
            near = np.sort(np.argsort(((away @ _inverse(scatter)[0]) * away).sum(axis=1), kind="stable")[:half])
            if before is not None and (near == before).all():
                break
            before = near
            centre, scatter = x[near].mean(axis=0), CONSISTENCY * np.cov(x[near].T, bias=True)
        score = _inverse(scatter)[1]
        if best is None or score < best[2] - 1e-9:
            best = (centre, scatter, score)
    return best


def _piece(table: pa.Table) -> pa.Table:
    """The estimate of one piece of a group, if it has enough rows; of a group of several pieces also its rows, in packs."""
    x = np.stack([table.column(c).to_numpy() for c in _NAMES], axis=1)
    g, start = table.column("g")[0].as_py(), table.column("piece")[0].as_py()
    rows = []
    if len(x) > _P + 1:
        centre, scatter, score = mcd(x / _FLOOR)
        rows.append((g, start, len(x), (centre * _FLOOR).tolist(), (scatter * np.outer(_FLOOR, _FLOOR))[_UPPER].tolist(), score, None))
    if table.column("pieces")[0].as_py() > 1:
        rows += [(g, start, None, None, None, None, x[i : i + PACK].ravel()) for i in range(0, len(x), PACK)]
    kind = pa.struct([("lang", pa.string()), ("source", pa.string()), ("rest", pa.bool_())])
    vector = pa.list_(pa.float64())
    types = [kind, pa.int32(), pa.int64(), vector, vector, pa.float64(), vector]
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["g", "start", "n", "centre", "scatter", "score", "vectors"])


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs with an estimate to counts and moments about its centre: one row for each class of distances in a batch."""
    for batch in batches:
        alike: dict[tuple, list[int]] = {}
        for i, key in enumerate(zip(batch.column("g").to_pylist(), batch.column("start").to_pylist())):
            alike.setdefault((*key[0].values(), key[1]), []).append(i)
        for places in alike.values():
            one = batch.take(pa.array(places))
            centre, inverse = (np.array(one.column(c)[0].as_py()) for c in ("centre", "inverse"))
            away = one.column("vectors").flatten().to_numpy().reshape(-1, _P) - centre
            distance = ((away @ inverse.reshape(_P, _P)) * away).sum(axis=1)
            classes, at, rows = np.unique(np.floor(np.log(np.maximum(distance, 1e-12)) * CLASSES).astype(np.int64), return_inverse=True, return_counts=True)
            sums = [np.bincount(at, away[:, i]) for i in range(_P)] + [np.bincount(at, away[:, i] * away[:, j]) for i, j in zip(*_UPPER)]
            same = [pa.array([one.column(c)[0].as_py()] * len(rows), one.schema.field(c).type) for c in ("g", "start", "n")]
            yield pa.RecordBatch.from_arrays([*same, *map(pa.array, (classes, rows, *sums))], ["g", "start", "n", "class", "rows", *_MOMENTS])


def _inverted(keep: list[str]):
    """Adds `inverse` (all of it, floored) and `score` to rows with `scatter` (its upper triangle); null without."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale = np.outer(_FLOOR, _FLOOR)
        for batch in batches:
            inverses, scores = [], []
            for row in batch.column("scatter").to_pylist():
                if row is None or any(v is None for v in row):
                    inverses.append(None)
                    scores.append(None)
                    continue
                m = np.zeros((_P, _P))
                m[_UPPER] = row
                inverse, score = _inverse((m + m.T - np.diag(np.diag(m))) / scale)
                inverses.append((inverse / scale).ravel().tolist())
                scores.append(score)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(inverses, pa.list_(pa.float64())), pa.array(scores, pa.float64())], [*keep, "inverse", "score"])

    return run


def _distance() -> F.Column:
    terms = [f"({a} - centre[{i}]) * ({b} - centre[{j}]) * inverse[{i * _P + j}]" for i, a in enumerate(_NAMES) for j, b in enumerate(_NAMES)]
    return F.expr(" + ".join(terms))


def _whole_groups(packs: DataFrame, starts: DataFrame) -> DataFrame:
    """C-steps over all `packs` (g, vectors) of large groups from `starts` (g, start, n, centre, scatter, score): the best of each group."""
    keep = ["g", "start", "n", "centre", "scatter"]
    schema = ", ".join(x for x in _ESTIMATE.split(", ") if not x.startswith("score")) + ", inverse array<double>, score double"
    sums = f"g {_GROUP}, start int, n long, class long, rows long, " + ", ".join(f"{m} double" for m in _MOMENTS)
    model = materialize(starts.select(*keep).mapInArrow(_inverted(keep), schema), "mcd_start")
    mean = [F.sum(m) / F.sum("rows") for m in _MOMENTS]
    places = list(zip(*_UPPER))
    for step in range(WHOLE_STEPS):
        near = packs.join(small(model.select("g", "start", "n", "centre", "inverse")), "g")
        seen = near.mapInArrow(_classes, sums).groupBy("g", "start", "n", "class").agg(*[F.sum(c).alias(c) for c in ("rows", *_MOMENTS)])
        seen = seen.withColumn("before", F.sum("rows").over(W.partitionBy("g", "start").orderBy("class")) - F.col("rows"))
        half = seen.where(F.col("before") < F.floor((F.col("n") + _P + 1) / 2))
        scatter = [(mean[_P + k] - mean[i] * mean[j]) * CONSISTENCY for k, (i, j) in enumerate(places)]
        moments = half.groupBy("g", "start").agg(F.first("n").alias("n"), F.array(*mean[:_P]).alias("away"), F.array(*scatter).alias("scatter"))
        moments = moments.join(model.select("g", "start", F.col("centre").alias("old")), ["g", "start"])
        moments = moments.select("g", "start", "n", F.zip_with("old", "away", lambda a, b: a + b).alias("centre"), "scatter")
        after = materialize(moments.mapInArrow(_inverted(keep), schema), f"mcd_{step}")
        was = model.select("g", "start", F.col("score").alias("was"))
        moved = after.join(was, ["g", "start"]).agg(F.max(F.abs(F.col("score") - F.col("was")))).first()[0]
        model = after
        if moved is None or moved < STILL:
            break
    best = model.groupBy("g").agg(F.min(F.struct("score", "start", "n", "centre", "scatter")).alias("b"))
    return best.select("g", F.col("b.start").alias("start"), F.col("b.n").alias("n"), F.col("b.centre").alias("centre"), F.col("b.scatter").alias("scatter"), F.col("b.score").alias("score"))


def _pooled(estimates: DataFrame, *keys: str) -> DataFrame:
    """Groups' estimates to one: n, centre, and scatter within and between groups."""
    mean = lambda e: F.sum(F.col("n") * e) / F.sum("n")
    c = [F.col("centre")[i] for i in range(_P)]
    places = [(i, j) for i in range(_P) for j in range(i, _P)]
    within = [mean(F.col("scatter")[k]) + mean(c[i] * c[j]) - mean(c[i]) * mean(c[j]) for k, (i, j) in enumerate(places)]
    return estimates.groupBy(*keys).agg(F.sum("n").alias("n"), F.array(*[mean(x) for x in c]).alias("centre"), F.array(*within).alias("scatter"))


def _leaning(name: str, own: str, parent: str) -> F.Column:
    """`name` of the own estimate averaged with the parent's by numbers of documents; whichever there is."""
    w = F.col(f"{own}.n") / (F.col(f"{own}.n") + PRIOR)
    both = F.zip_with(F.col(f"{own}.{name}"), F.col(f"{parent}.{name}"), lambda a, b: w * a + (1 - w) * b)
    return F.coalesce(both, F.col(f"{own}.{name}"), F.col(f"{parent}.{name}")).alias(name)


def estimates(rows: DataFrame, id_col: str = "doc_id", piece: int = PIECE) -> DataFrame:
    """Per (lang, source) of `rows`: centre, inverse scatter; null where nothing can be estimated."""
    base = rows.where("n_words > 0")
    groups = base.groupBy("lang", "source").agg(F.count("*").alias("own_n"))
    rest = F.col("own_n") <= _P + 1
    groups = groups.withColumn("g", F.struct("lang", F.when(~rest, F.col("source")).alias("source"), rest.alias("rest")))
    groups = materialize(groups, "groups")
    totals = groups.groupBy("g").agg(F.sum("own_n").alias("total"), F.ceil(F.sum("own_n") / piece).alias("pieces"))
    groups = materialize(groups.join(totals, "g").select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), "g", "total", "pieces"), "group_sizes")

    salt = F.coalesce(F.col(id_col).cast("string"), F.monotonically_increasing_id().cast("string"))
    placed = base.select("lang", "source", F.xxhash64(salt).alias("salt"), *_NAMES)
    placed = placed.join(small(groups), placed["lang"].eqNullSafe(F.col("g_lang")) & placed["source"].eqNullSafe(F.col("g_source")))
    placed = materialize(placed.select("g", "total", "pieces", F.pmod("salt", "pieces").cast("int").alias("piece"), *_NAMES), "pieces")
    found = materialize(placed.drop("total").groupBy("g", "piece").applyInArrow(_piece, f"{_ESTIMATE}, vectors array<double>"), "piece_estimates")
    packs, found = found.where("vectors is not null").select("g", "vectors"), found.where("centre is not null").drop("vectors")
    sizes = groups.select("g", "total", "pieces").distinct()
    found = found.join(sizes, "g").withColumn("n", F.col("total"))
    names = ["g", "start", "n", "centre", "scatter", "score"]
    one = found.where("pieces = 1").select(*names)
    rank = F.row_number().over(W.partitionBy("g").orderBy("score", "start"))
    two = materialize(found.where("pieces > 1").withColumn("rank", rank).where("rank <= 2").select(*names), "group_starts")
    if not two.isEmpty():
        one = one.unionByName(_whole_groups(packs, two))
    one = materialize(one.select("g", "n", "centre", "scatter"), "group_estimates")

    langs = materialize(_pooled(one.withColumn("lang", F.col("g.lang")), "lang"), "language_estimates")
    every = _pooled(langs.withColumn("all", F.lit(0)), "all")
    pack = lambda df, name, *keys: df.select(*keys, F.struct("n", "centre", "scatter").alias(name))
    above = groups.join(F.broadcast(pack(every, "top", "all")), F.lit(0) == F.col("all"), "left")  # one row at most
    langs = small(pack(langs, "mid", F.col("lang").alias("m_lang")))
    above = above.join(langs, above["g_lang"].eqNullSafe(F.col("m_lang")), "left")
    middle = F.struct(F.col("mid.n").alias("n"), _leaning("centre", "mid", "top"), _leaning("scatter", "mid", "top"))
    full = above.withColumn("mid", middle).join(pack(one, "own", "g"), "g", "left")
    full = full.select(F.col("g_lang").alias("lang"), F.col("g_source").alias("source"), _leaning("centre", "own", "mid"), _leaning("scatter", "own", "mid"))
    keep = ["lang", "source", "centre", "scatter"]
    return full.mapInArrow(_inverted(keep), "lang string, source string, centre array<double>, scatter array<double>, inverse array<double>, score double")


def judge(documents: DataFrame, id_col: str = "doc_id", cutoff: float = CUTOFF, piece: int = PIECE, **columns) -> DataFrame:
    """One row per document row: id, counts, base_failed, distance (null without words or estimate), kept."""
    rows = materialize(statistics(documents, id_col, **columns), "statistics")
    model = estimates(rows, id_col, piece).select(F.col("lang").alias("m_lang"), F.col("source").alias("m_source"), "centre", "inverse")
    model = small(materialize(model, "models"))
    got = rows.join(model, rows["lang"].eqNullSafe(model["m_lang"]) & rows["source"].eqNullSafe(model["m_source"]), "left")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    got = got.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), _distance().alias("distance"))
    return got.withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff))

"""Near-duplicate documents: one-permutation MinHash, bands, star candidates, exact confirmation.

Two documents are linked if the Jaccard similarity of their sets of word 5-shingles is 0.75 or
more; a document's class is its connected component.

1. *Sets.* Documents with equal sets (compared by size and two sums of independent hashes) are
   one node, named by the smallest id; copies are never paired.
2. *Signature.* Each shingle's hash falls into one of 160 bins by its value; a bin keeps its
   smallest. An empty bin takes the value of the first non-empty bin in its own random order of
   bins (optimal densification). Forty bands of four bins make bucket keys: a pair at 0.75
   shares none with probability (1 - 0.75^4)^40, about 2.5e-7.
3. *Stars.* In each bucket one hub (the member with the most company over all its buckets) is
   paired with the others: a bucket of n makes n - 1 candidates. Candidates are confirmed on
   their full sets, and components are formed.
4. *The rest.* A bucket that still holds several components may hide a link that no star had.
   Its members go through an exact prefix-filter join. Shingles that one component alone has
   cannot link anything; the others are ordered by how many sets have them, the rarest first.
   Two linked sets share a shingle among their first n - overlap + 1, at places that leave room
   for the overlap. Members of one component are not paired again. So no pair that meets in a
   bucket is lost, and pairs are not expanded within groups. A shingle in the prefixes of very
   many sets of different components is one key of a join that Spark may split over tasks.

Nodes are groups of equal sets, named by their smallest id. Where ids are null or repeat with different texts, the
name also holds the set's sums, so that each row follows its own text.

Defined results: null or empty texts, or texts of white space, have empty sets and are linked
with nothing; each such row is kept. Rows that repeat an id with different texts are documents of their own: each has the
component and `kept` of its own text, so one may be kept and the other not. A null id sorts last: such a row is linked
like any other, its component is the smallest id that it reaches (null if none is known), and it is kept if that is
null. `keep_first` keeps one row of each class, whatever repeats: the smallest id, and of its rows the one with the
least text key; exact repeats of that row go. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _text
from ._components import components
from ._store import drop, materialize, only, release, small, text_key, without

SHINGLE, BINS, ROWS = 5, 160, 4
#: Similarity as a fraction.
NUM, DEN = 75, 100

_ORDER = np.random.default_rng(75).random((BINS, BINS))
_ODD = np.random.default_rng(76).integers(0, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = _text.mix(np.arange(BINS // ROWS, dtype=np.uint64) + np.uint64(77))


def shingle_sets(t: _text.Texts) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its shingles."""
    w = _text.words_of(t, _text.NOT_SPACE, lower=True)
    h = w.hashes()
    g = _text.grams(h, SHINGLE)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        n = b - a
        if n >= SHINGLE:
            out.append(np.unique(g[a : b - SHINGLE + 1]))
        else:
            out.append(_text.grams(h[a:b], n, 1)[:1] if n else g[:0])
    return out


def signature(s: np.ndarray) -> np.ndarray:
    """One-permutation MinHash of a sorted set, every bin filled."""
    bins = ((s >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    new = np.ones(len(s), bool)
    new[1:] = bins[1:] != bins[:-1]
    filled = bins[new]
    out = np.zeros(BINS, np.uint64)
    out[filled] = s[new]
    if len(filled) < BINS:
        empty = np.ones(BINS, bool)
        empty[filled] = False
        out[empty] = out[filled[_ORDER[empty][:, filled].argmin(axis=1)]]
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    return _text.mix((_text.mix(sig.reshape(-1, ROWS)) * _ODD).sum(axis=1, dtype=np.uint64) ^ _SALT)


def _digests(s: np.ndarray) -> tuple[int, int]:
    a = _text.mix(s ^ np.uint64(0x1234567)).sum(dtype=np.uint64)
    b = _text.mix(s ^ np.uint64(0x89ABCDEF01)).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for t in _text.split_texts(batch.column(1)):
            sets = shingle_sets(t)
            pairs = [_digests(s) for s in sets]
            keys = [band_keys(signature(s)) if len(s) else s for s in sets]
            flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c).slice(t.lo, t.hi - t.lo) for c in (0, 2)],
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([p[0] for p in pairs], pa.int64()),
                    pa.array([p[1] for p in pairs], pa.int64()),
                    _text.lists(_text.as_long(flat), np.array([len(k) for k in keys])),
                ],
                ["id", "tid", "n", "d1", "d2", "bands"],
            )


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for t in _text.split_texts(batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(t.lo, t.hi - t.lo), pa.array([s.tobytes() for s in shingle_sets(t)], pa.binary())], ["rep", "shingles"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            if len(a) > len(b):
                a, b = b, a
            if DEN * len(a) < NUM * len(b):
                ok.append(False)
                continue
            at = np.minimum(np.searchsorted(b, a), len(b) - 1)
            both = int((b[at] == a).sum())
            ok.append(DEN * both >= NUM * (len(a) + len(b) - both))
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])


def _confirmed(pairs: DataFrame, sets: DataFrame, kind: str) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("set_b"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "set_a", "set_b").mapInArrow(_confirm, f"a {kind}, b {kind}")


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, component, shingles) to one row a shingle."""
    for batch in batches:
        for i in range(batch.num_rows):
            s = np.frombuffer(batch.column(2)[i].as_buffer(), np.uint64)
            row = pa.array(np.zeros(len(s), np.int64))
            own = [batch.column(c).slice(i, 1).take(row) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(np.full(len(s), len(s)), pa.int64()), _text.as_long(s)], ["rep", "component", "n", "token"])


def _rest(members: DataFrame, sets: DataFrame, kind: str) -> DataFrame:
    """Links between components among `members` (rep, component), by an exact prefix-filter join."""
    full = materialize(members.join(sets, "rep").select("rep", "component", "shingles"), "unresolved")
    tokens = full.mapInArrow(_tokens, f"rep {kind}, component {kind}, n long, token long")
    seen = tokens.groupBy("token").agg(F.count("*").alias("sets"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("token", "sets")
    own = W.partitionBy("rep")  # one set at most
    place = F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("sets", "token"))
    rows = tokens.join(seen, "token").withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * NUM / DEN) + 1)
    rows = materialize(rows.select("rep", "component", "n", "place", "token"), "prefixes")
    x, y = rows.alias("x"), rows.alias("y")
    overlap = F.ceil(F.lit(NUM) * (F.col("x.n") + F.col("y.n")) / F.lit(NUM + DEN))
    near = (
        (F.col("x.token") == F.col("y.token"))
        & (F.col("x.rep") < F.col("y.rep"))
        & (F.col("x.component") != F.col("y.component"))
        & (DEN * F.least("x.n", "y.n") >= NUM * F.greatest("x.n", "y.n"))
        & (1 + F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place")) >= overlap)
    )
    pairs = x.join(y, near).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()
    return _confirmed(pairs, full, kind)


def _labelled(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document row: id, tid (text key), n, class (null without shingles), component_id, kept."""
    spark = documents.sparkSession
    kind = documents.schema[id_col].dataType.simpleString()
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), text_key(F.col(text_col)).alias("tid"))
    signed = materialize(docs.mapInArrow(_sign, f"id {kind}, tid long, n long, d1 long, d2 long, bands array<long>"), "signatures")
    known = signed.where("n > 0")
    least = F.min(F.struct(F.col("id").isNull().alias("unknown"), "id", "tid"))
    groups = known.groupBy("n", "d1", "d2").agg(least.alias("least"), F.first("bands").alias("bands"))
    groups = materialize(groups.select("n", "d1", "d2", F.col("least.id").alias("id"), F.col("least.tid").alias("tid"), "bands"), "groups")
    plain = groups.groupBy("id").count().where("count > 1 or id is null").isEmpty()
    node = F.col("id") if plain else F.struct(F.col("id").isNull().alias("unknown"), "id", "d1", "d2")
    node_kind = kind if plain else f"struct<unknown:boolean,id:{kind},d1:bigint,d2:bigint>"
    nodes = groups.withColumn("rep", node)

    rows = nodes.select("rep", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    met = materialize(rows.join(shared, "key"), "buckets")
    company = met.groupBy("rep").agg(F.sum(F.col("size") - 1).alias("company"))
    hubs = met.join(company, "rep").groupBy("key").agg(F.max(F.struct("company", "rep")).alias("hub")).select("key", F.col("hub.rep").alias("a"))
    stars = materialize(met.join(hubs, "key").where("a != rep").select("a", F.col("rep").alias("b")).distinct(), "candidates")
    del rows, shared, company, hubs
    release(spark)

    wanted = stars.select("a").unionAll(stars.select("b")).distinct().withColumnRenamed("a", "rep")
    wanted = materialize(wanted.join(nodes, "rep").select("rep", F.col("id").alias("want_id"), F.col("tid").alias("want_tid")), "candidate_texts")
    wanted = small(wanted)
    texts = docs.join(wanted, docs["id"].eqNullSafe(wanted["want_id"]) & (docs["tid"] == wanted["want_tid"])).select("rep", "text")
    full = texts.mapInArrow(_full_sets, f"rep {node_kind}, shingles binary")
    if not known.groupBy("id", "tid").count().where("count > 1").isEmpty():  # rows that repeat in full
        full = full.dropDuplicates(["rep"])
    sets = materialize(full, "sets")
    links = materialize(_confirmed(stars, sets, node_kind), "confirmed")
    release(spark)

    first = materialize(components(links), "components")
    placed = met.join(first.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    open_keys = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("key")
    members = materialize(placed.join(open_keys, "key", "left_semi").select("rep", "component").distinct(), "members")
    more = materialize(_rest(members, sets, node_kind), "confirmed_rest")
    if more.isEmpty():
        final = first
    else:
        final = materialize(components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(more)), "components")
    drop(sets)
    drop(met)
    release(spark)

    of_group = nodes.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("n", "d1", "d2", F.coalesce("component", "rep").alias("class"))
    got = signed.drop("bands").join(of_group, ["n", "d1", "d2"], "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("class") if plain else F.col("class.id"))
    return got.select("id", "tid", "n", "class", component.alias("component_id")).withColumn("kept", (F.col("n") == 0) | F.col("id").eqNullSafe(F.col("component_id")))


def classes(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: id, n_shingles, component_id, kept."""
    return _labelled(documents, id_col, text_col).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "kept")


def keep_first(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that come first in their class; one of each class, and all without shingles."""
    rows = materialize(_labelled(documents, id_col, text_col).where("n > 0").select("id", "tid", "class"), "classes")
    first = rows.groupBy("class").agg(F.min(F.struct(F.col("id").isNull().alias("unknown"), "id", "tid")).alias("first"))
    first = first.select(F.col("first.id").alias("first_id"), F.col("first.tid").alias("first_tid"))
    # an id and a text have one class, so rows meet their class's first by these: a large class is no key of the join
    later = rows.join(first, rows["id"].eqNullSafe(first["first_id"]) & (rows["tid"] == first["first_tid"]), "left_anti")
    kept = without(documents, materialize(later.select("id", "tid").distinct(), "near_duplicates"), id_col, text_col)
    again = materialize(rows.groupBy("id", "tid").count().where("count > 1").select("id", "tid"), "repeated_rows")
    if again.isEmpty():
        return kept
    return without(kept, again, id_col, text_col).unionByName(only(kept, again, id_col, text_col).dropDuplicates([id_col, text_col]))

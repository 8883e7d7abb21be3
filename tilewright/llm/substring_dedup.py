"""Substring dedup over a compacted de Bruijn graph of repeated token k-mers.

A window is `k` consecutive words of one document. Windows whose words also start in a
document with a smaller id are covered; covered words are removed. The graph is built only
where something repeats:

1. *Anchors.* The smallest 5-gram hash of each window is its anchor, so equal windows have
   equal anchors. Anchors are counted over documents; those in one document alone cannot
   carry a repeated window. Identical texts count once, through their smallest id.
2. *Edges.* A window that holds a repeated anchor is an edge between its first and last k-1
   words. Edges are grouped by the 64-bit hashes of both nodes; those of two documents or more
   stay, with their first place: the smallest document and the smallest position in it.
3. *Compaction.* An edge joins its successor where the node between them has one edge in and
   one out, and the successor's first place is the next word of the same document. Chains of
   such edges become paths: (document, position, edges).
4. *Verification.* Windows meet the paths through their edges, each with its own and its source's
   coordinates. A stretch that goes forward in both along one path is a verified span; what is removed
   are the words of spans. Edges are equal only if both node hashes, of twelve words each, are.

Repeated anchors travel as a Bloom filter up to a size; beyond it windows meet the table of repeated anchors in a
shuffled join, with the same result.

Defined results: a null or empty text has no words; texts of fewer than k words lose
nothing. Rows with equal ids are one document for the rule (no window of one covers the
other), yet each row, even of another text, gives its own result. Null ids sort last and count
as one document. An empty table gives an empty result. Bytes that are not UTF-8 cannot occur in a string column that
Spark has checked; where they do, they are hashed as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _bloom, _text
from ._store import drop, materialize, release, small, text_key, without

K, ANCHOR = 13, 7
#: Repeated anchors that a Bloom filter takes (sixteen bits each, 64 MB); more are looked up by a shuffled join.
FILTERED = 1 << 25


def _anchors(h: np.ndarray, k: int, anchor: int) -> np.ndarray:
    """For each word, the smallest anchor hash of the k words from it on."""
    return _text.smallest(_text.grams(h, anchor), k - anchor + 1)


def _anchor_rows(k: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in _text.split_texts(batch.column(1)):
                w = _text.words_of(t, _text.NOT_SPACE)
                h = w.hashes()
                best, ok = _anchors(h, k, anchor), w.left() >= k
                owner = np.repeat(np.arange(t.hi - t.lo), w.counts)[ok]
                best = best[ok]
                new = np.ones(len(best), bool)
                new[1:] = (best[1:] != best[:-1]) | (owner[1:] != owner[:-1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(t.lo, t.hi - t.lo).take(pa.array(owner[new])), _text.as_long(best[new])], ["id", "anchor"])

    return run


def _window_rows(shared, k: int, anchor: int):
    """Windows whose anchor passes the filter (all without one): id, text key, anchor, position, whether the
    text had it before, and the hashes of the first and last k-1 words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in _text.split_texts(batch.column(1)):
                w = _text.words_of(t, _text.NOT_SPACE)
                h = w.hashes()
                at, best = np.flatnonzero(w.left() >= k), _anchors(h, k, anchor)
                if shared is not None:
                    at = at[_bloom.passes(shared.value, best[at])]
                node = _text.grams(h, k - 1, 2)
                a, b = node[at], node[at + 1] if len(at) else node[:0]
                owner = np.searchsorted(w.first, at, "right") - 1
                order = np.lexsort((at, b, a, owner))
                again = np.zeros(len(at), bool)
                again[order[1:]] = (owner[order[1:]] == owner[order[:-1]]) & (a[order[1:]] == a[order[:-1]]) & (b[order[1:]] == b[order[:-1]])
                own = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(c).slice(t.lo, t.hi - t.lo).take(own) for c in (0, 2)],
                        _text.as_long(best[at]),
                        pa.array(at - w.first[owner], pa.int32()),
                        pa.array(again),
                        _text.as_long(a),
                        _text.as_long(b),
                    ],
                    ["id", "tid", "anchor", "pos", "again", "node_in", "node_out"],
                )

    return run


def _joined(w: _text.Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of the kept words, a space after each; where each text's begin, with the end)."""
    at = np.flatnonzero(keep)
    size = w.end[at] - w.start[at] + 1
    to = np.concatenate([[0], np.cumsum(size)])
    where = np.repeat(w.start[at] - to[:-1], size) + np.arange(to[-1])
    out = np.append(w.data, np.uint8(32))[where]
    out[to[1:] - 1] = 32
    return out, to[np.searchsorted(at, w.first)]


def _cut(k: int, name: str, text: bool):
    """Remove covered words: (id, text, ranges, copy) to the digest columns, and the kept text if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranges, copies = batch.column(2), np.asarray(batch.column(3))
            edge = ranges.offsets.to_numpy()
            start, end = (ranges.values.field(c).to_numpy().astype(np.int64) for c in ("start", "end"))
            for t in _text.split_texts(batch.column(1)):
                w = _text.words_of(t, _text.NOT_SPACE)
                n, these = t.hi - t.lo, slice(edge[t.lo], edge[t.hi])
                first = np.repeat(w.first[:-1], np.diff(edge[t.lo : t.hi + 1]))
                step = np.zeros(len(w.start) + 1, np.int32)
                np.add.at(step, first + start[these], 1)
                np.add.at(step, first + end[these], -1)
                gone = np.cumsum(step[:-1]) > 0
                gone |= np.repeat(copies[t.lo : t.hi] & (w.counts >= k), w.counts)
                removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[w.first])
                out, at = _joined(w, ~gone)
                kept = [out[a : max(a, b - 1)].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                columns = [batch.column(0).slice(t.lo, n), pa.array(w.counts, pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())]
                names = [name, "n_words", "n_removed", "kept_sha256"]
                if text:
                    columns, names = [*columns, pa.array([x.decode("utf-8", "replace") for x in kept], pa.string())], [*names, "kept_text"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def repeated_spans(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, anchor: int = ANCHOR, filtered: int = FILTERED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(spans, copies, paths).

    spans: id, tid (text key), src, path (where it begins in `src`), start, length (windows), src_start: stretches along
    a path that go forward together in the document and in the smaller one `src`. copies: id and tid of texts identical
    to a smaller document's. paths: src, src_start, length (edges) of compacted repeated paths.
    """
    spark = documents.sparkSession
    kind = documents.schema[id_col].dataType.simpleString()
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), text_key(F.col(text_col)).alias("tid")).where(F.col("text").isNotNull())
    prints = docs.select("id", "tid", F.md5("text").alias("digest"))
    groups = prints.groupBy("digest").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("n"), F.count("id").alias("known"))
    groups = groups.where((F.col("n") > 1) & F.col("least").isNotNull() & ((F.col("most") > F.col("least")) | (F.col("known") < F.col("n"))))
    later = F.col("id").isNull() | (F.col("id") > F.col("least"))
    copies = materialize(prints.join(groups, "digest").where(later).select("id", "tid").distinct(), "copies")
    singles = without(docs, copies, "id", "text")

    rows = singles.mapInArrow(_anchor_rows(k, anchor), f"id {kind}, anchor long")
    counted = rows.groupBy("anchor").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.max(F.col("id").isNull()).alias("unknown"))
    repeated = materialize(counted.where((F.col("most") > F.col("least")) | (F.col("unknown") & F.col("least").isNotNull())).select("anchor"), "repeated_anchors")
    n = repeated.count()
    shared = spark.sparkContext.broadcast(_bloom.build(repeated, "anchor", _bloom.size_for(n))) if n <= filtered else None
    del rows, counted
    release(spark)

    windows = singles.select("id", "text", "tid").mapInArrow(_window_rows(shared, k, anchor), f"id {kind}, tid long, anchor long, pos int, again boolean, node_in long, node_out long")
    if shared is None:
        windows = windows.join(repeated, "anchor", "left_semi")
    windows = materialize(windows.drop("anchor"), "windows")
    drop(repeated)
    # plain numbers alone, so that the states stay in one hash table
    edges = windows.groupBy("node_in", "node_out").agg(
        F.min("id").alias("src"), F.min_by("pos", F.when(~F.col("again"), F.col("id"))).alias("src_pos"), F.max("id").alias("most"), F.max(F.col("id").isNull()).alias("unknown")
    )
    edges = materialize(edges.where((F.col("most") > F.col("src")) | (F.col("unknown") & F.col("src").isNotNull())).select("node_in", "node_out", "src", "src_pos"), "edges")
    release(spark)

    ends = edges.select(F.col("node_in").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in"), F.lit(None).cast(kind).alias("p_src"), F.lit(None).cast("int").alias("p_pos")).unionAll(
        edges.select("node_out", F.lit(0), F.lit(1), "src", "src_pos")
    )
    simple = ends.groupBy("node").agg(F.sum("out").alias("o"), F.sum("in").alias("i"), F.max("p_src").alias("p_src"), F.max("p_pos").alias("p_pos")).where("o = 1 and i = 1")
    joined = edges.join(simple, F.col("node_in") == F.col("node"), "left")
    follows = (F.col("p_src") == F.col("src")) & (F.col("p_pos") + 1 == F.col("src_pos"))
    along = W.partitionBy("src").orderBy("src_pos").rowsBetween(W.unboundedPreceding, 0)
    chained = joined.withColumn("path", F.max(F.when(F.coalesce(follows, F.lit(False)), None).otherwise(F.col("src_pos"))).over(along)).select("node_in", "node_out", "src", "src_pos", "path")
    chained = materialize(chained, "chained_edges")
    drop(edges)
    release(spark)
    paths = chained.groupBy("src", "path").agg(F.count("*").alias("length")).withColumnRenamed("path", "src_start")

    met = windows.join(chained, ["node_in", "node_out"]).where(F.col("id").isNull() | (F.col("id") > F.col("src")))
    met = met.select("id", "tid", "src", "path", (F.col("pos") - F.col("src_pos")).alias("shift"), "pos")
    # within one document, path and shift, places of one stretch have the same difference from their rank
    stretch = F.col("pos") - F.dense_rank().over(W.partitionBy("id", "tid", "src", "path", "shift").orderBy("pos"))
    spans = met.withColumn("stretch", stretch).groupBy("id", "tid", "src", "path", "shift", "stretch").agg(F.min("pos").alias("start"), (F.max("pos") - F.min("pos") + 1).alias("length"))
    spans = materialize(spans.select("id", "tid", "src", "path", "start", "length", (F.col("start") - F.col("shift")).alias("src_start")), "spans")
    drop(windows)
    release(spark)
    return spans, copies, paths


def remove_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, anchor: int = ANCHOR, with_text: bool = True, **kw) -> DataFrame:
    """One row per document row: id, n_words, n_removed, kept_sha256, and kept_text if asked for."""
    spans, copies, _ = repeated_spans(documents, id_col, text_col, k, anchor, **kw)
    # words covered, as few ranges a document as can be: spans that meet or overlap are one
    words = spans.select("id", "tid", "start", (F.col("start") + F.col("length") + k - 1).alias("end"))
    line = W.partitionBy("id", "tid").orderBy("start", "end")
    reached = F.max("end").over(line.rowsBetween(W.unboundedPreceding, -1))
    words = words.withColumn("opens", F.when(reached >= F.col("start"), 0).otherwise(1)).withColumn("nth", F.sum("opens").over(line.rowsBetween(W.unboundedPreceding, 0)))
    todo = words.groupBy("id", "tid", "nth").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    todo = todo.groupBy("id", "tid").agg(F.collect_list(F.struct("start", "end")).alias("ranges"), F.lit(False).alias("copy"))
    none = F.array().cast(todo.schema["ranges"].dataType)
    todo = todo.unionByName(copies.select("id", "tid", none.alias("ranges"), F.lit(True).alias("copy")))
    todo = small(materialize(todo.toDF("todo_id", "todo_tid", "ranges", "copy"), "removals"))
    kind = documents.schema[id_col].dataType.simpleString()
    docs = documents.select(F.col(id_col), F.col(text_col).alias("text"), text_key(F.col(text_col)).alias("tid"))
    got = docs.join(todo, docs[id_col].eqNullSafe(todo["todo_id"]) & (docs["tid"] == todo["todo_tid"]), "left").select(id_col, "text", F.coalesce("ranges", none).alias("ranges"), F.coalesce("copy", F.lit(False)).alias("copy"))
    return got.mapInArrow(_cut(k, id_col, with_text), f"`{id_col}` {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)

"""Benchmark decontamination by winnowing.

Of every span of eight words, the smallest of its four 5-gram hashes (the rightmost among
equals) is its fingerprint. A span that a document shares with a benchmark item has the same
fingerprint in both, so looking fingerprints up finds every shared span of eight words or
more. A Bloom filter of bounded size over the benchmark's fingerprints travels to the tasks;
what passes it is extended to the whole span and joined on (fingerprint, words), which
makes the result exact. Only spans that pass the filter ever leave the scan.

Items of fewer than eight words, but not none, are one window of their own length; for each
such length (at most seven) all grams of that length are fingerprints.

The items of a window are never carried by documents. Windows with the same items share the name of that set; a document
has the sets of its windows, and each distinct combination of sets is turned into its items once. A window that a million
items share is so one name in every document that has it.

Defined results: a null or empty text has no words, hits or items. Each input row gives one
row, repeated rows and null ids included. Windows of items without an id are hits, and `clean` goes by them; such items are neither
counted nor listed. Items that repeat an id are one item. An empty benchmark hits nothing, an empty table gives an empty
result. Bytes that are not UTF-8 count as one replacement character each. Very long texts are handled whole, in memory of some ten bytes a byte. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bloom, _text
from ._store import BROADCAST_BYTES, materialize, small, text_key, without

SPAN, GRAM = 8, 5

_WINDOWS = "key string, windows array<struct<fp:long,window:string>>"
_HITS = "row long, {id} {kind}, tid long, n_words long, spans array<struct<fp:long,start:int,len:int,window:string>>"


def _selected(h: np.ndarray) -> np.ndarray:
    """For each word, the fingerprint of the eight words from it on."""
    return _text.smallest(_text.grams(h, GRAM), SPAN - GRAM + 1)


def _short(h: np.ndarray, n: int) -> np.ndarray:
    return _text.mix(_text.grams(h, n, 1) ^ np.uint64(n))


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("fp", pa.int64()), ("window", pa.string())]))
    for batch in batches:
        for t in _text.split_texts(batch.column(1)):
            w = _text.words_of(t, _text.ALNUM, lower=True)
            h, out = w.hashes(), []
            best = _selected(h) if len(h) else h
            for a, n in zip(w.first, w.counts, strict=False):
                a, n = int(a), int(n)
                if n >= SPAN:
                    found = [(int(best[i].view(np.int64)), w.span(i, SPAN).decode("utf-8", "replace")) for i in range(a, a + n - SPAN + 1)]
                else:
                    found = [(int(_short(h[a : a + n], n)[0].view(np.int64)), w.span(a, n).decode("utf-8", "replace"))] if n else []
                out.append([{"fp": f, "window": x} for f, x in found])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(t.lo, t.hi - t.lo), pa.array(out, kind)], ["key", "windows"])


def _candidates(shared, short: list[int], name: str):
    """A function over (id, text, text key) batches: per text its words and the spans that may be a benchmark's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row, bloom = TaskContext.get().partitionId() << 40, shared.value
        for batch in batches:
            for t in _text.split_texts(batch.column(1)):
                w = _text.words_of(t, _text.ALNUM, lower=True)
                h, left, found = w.hashes(), w.left(), []
                if len(h):
                    best = _selected(h)
                    ok = (left >= SPAN) & _bloom.passes(bloom, best)
                    found += [(i, SPAN, best[i]) for i in np.flatnonzero(ok)]
                    for n in short:
                        fp = _short(h, n)
                        found += [(i, n, fp[i]) for i in np.flatnonzero((left >= n) & _bloom.passes(bloom, fp))]
                found.sort(key=lambda x: x[0])
                at = np.array([x[0] for x in found], np.int64)
                owner = np.searchsorted(w.first, at, "right") - 1
                spans = pa.StructArray.from_arrays(
                    [
                        pa.array([int(x[2].view(np.int64)) for x in found], pa.int64()),
                        pa.array(at - w.first[owner], pa.int32()),
                        pa.array([x[1] for x in found], pa.int32()),
                        pa.array([w.span(int(x[0]), x[1]).decode("utf-8", "replace") for x in found], pa.string()),
                    ],
                    ["fp", "start", "len", "window"],
                )
                n = t.hi - t.lo
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + n)), *[batch.column(c).slice(t.lo, n) for c in (0, 2)], pa.array(w.counts, pa.int64()), _text.lists(spans, np.bincount(owner, minlength=n))],
                    ["row", name, "tid", "n_words", "spans"],
                )
                row += n

    return run


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(distinct fp, window and the name of its set of items; the items of each set, one a row, as strings)."""
    items = benchmark.select(F.col(item_col).cast("string").alias("key"), F.col(text_col).alias("text"))
    flat = materialize(items.mapInArrow(_item_windows, _WINDOWS).select("key", F.inline("windows")).distinct(), "item_windows")
    known = lambda salt: F.bit_xor(F.when(F.col("key").isNotNull(), F.xxhash64(F.lit(salt), F.col("key"))))
    windows = flat.groupBy("fp", "window").agg(F.count("key").alias("n"), known(1).alias("a"), known(2).alias("b"))
    windows = materialize(windows.select("fp", "window", F.md5(F.concat_ws(":", "n", "a", "b").cast("binary")).alias("item_set")), "benchmark_windows")
    one = windows.groupBy("item_set").agg(F.min(F.struct("fp", "window")).alias("w")).select("item_set", "w.*")
    return windows, flat.where("key is not null").join(one, ["fp", "window"]).select("item_set", F.col("key").alias("item"))


def spans(documents: DataFrame, windows: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, DataFrame]:
    """(documents with row, id, text key tid and n_words; matched spans with row, id, tid, start, len, window and item_set)."""
    lengths = F.size(F.split("window", " "))
    stats = windows.groupBy(lengths.alias("n")).count().collect()  # one row per length, eight at most
    short, total = sorted(r["n"] for r in stats if r["n"] < SPAN), sum(r["count"] for r in stats)
    kind = documents.schema[id_col].dataType.simpleString()
    docs = documents.select(F.col(id_col), F.col(text_col), text_key(F.col(text_col)))
    shared = documents.sparkSession.sparkContext.broadcast(_bloom.build(windows, "fp", _bloom.size_for(2 * total)))
    seen = materialize(docs.mapInArrow(_candidates(shared, short, id_col), _HITS.format(id=f"`{id_col}`", kind=kind)), "document_spans")
    found = seen.where(F.size("spans") > 0).select("row", id_col, "tid", F.inline("spans"))
    return seen.select("row", id_col, "tid", "n_words"), found.join(small(windows, broadcast_bytes), ["fp", "window"])


def _judged(documents: DataFrame, benchmark: DataFrame, id_col: str, listed: dict, text_col: str = "text", item_col: str = "item_id", benchmark_text: str = "text", **kw) -> DataFrame:
    """Per document row: id, n_words, n_hit, and the columns `listed`: expressions over `items`, the sorted array (null without)."""
    windows, members = benchmark_windows(benchmark, item_col, benchmark_text)
    docs, hits = spans(documents, windows, id_col, text_col, **kw)
    covered = F.expr(
        "aggregate(array_sort(at), named_struct('n', 0L, 'to', 0), (a, x) -> named_struct("
        "'n', a.n + greatest(0, x.start + x.len - greatest(a.to, x.start)), 'to', greatest(a.to, x.start + x.len)), a -> a.n)"
    )
    per_row = hits.groupBy("row").agg(F.collect_set(F.struct("start", "len")).alias("at"), F.array_sort(F.collect_set("item_set")).alias("sets"))
    per_row = materialize(per_row.select("row", covered.alias("n_hit"), "sets", F.md5(F.array_join("sets", ",").cast("binary")).alias("combination")), "hit_documents")
    parts = per_row.groupBy("combination").agg(F.first("sets").alias("sets")).select("combination", F.explode("sets").alias("item_set"))
    lists = parts.join(members, "item_set").groupBy("combination").agg(F.array_sort(F.collect_set("item")).alias("items"))
    lists = materialize(lists.select("combination", *[e.alias(c) for c, e in listed.items()]), "item_lists")
    per_row = per_row.drop("sets").join(lists, "combination", "left")
    return docs.join(per_row, "row", "left").select(id_col, "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), *listed)


def decontaminate(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **kw) -> DataFrame:
    """One row per document row: id, n_words, n_hit, items (sorted strings)."""
    got = _judged(documents, benchmark, id_col, {"items": F.col("items")}, **kw)
    return got.withColumn("items", F.coalesce("items", F.array().cast("array<string>")))


def digest(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **kw) -> DataFrame:
    """One row per document row: id, n_words, n_hit, n_items, items_sha256, contaminated."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    got = _judged(documents, benchmark, id_col, {"n_items": F.size("items").cast("long"), "items_sha256": sha(F.array_join("items", ","))}, **kw)
    n = F.coalesce("n_items", F.lit(0).cast("long"))
    return got.select(id_col, "n_words", "n_hit", n.alias("n_items"), F.coalesce("items_sha256", sha(F.lit(""))).alias("items_sha256"), (n >= 2).alias("contaminated"))


def clean(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", benchmark_text: str = "text", **kw) -> DataFrame:
    """The rows, with all their columns, whose own text shares no window with any item: a row goes by its text, not by its id."""
    windows, _ = benchmark_windows(benchmark, item_col, benchmark_text)
    _, hits = spans(documents, windows, id_col, text_col, **kw)
    return without(documents, materialize(hits.select(id_col, "tid").distinct(), "contaminated"), id_col, text_col)

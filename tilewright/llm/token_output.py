"""Token ids in a binary file format whose document boundaries are Elias-Fano encoded.

Documents are range-partitioned and sorted by id; each partition is a shard of blocks. A block
holds the ids of consecutive documents, concatenated as little-endian unsigned integers of two
bytes (four, for a vocabulary beyond 65,536), and the n + 1 document boundaries as an
Elias-Fano sequence: the low bits packed, the high bits in unary, and the place of every 256th
one of the unary part, so that `EliasFano.select` finds one boundary without a 64-bit table.
Blocks are rows of a Parquet table: Spark's committer makes a lost task leave nothing behind.

Tokenizing goes by distinct pre-tokens: the byte-level pattern's pieces are found for a whole
batch at once, each new piece is encoded once by the tokenizer's own model and kept in a
bounded table per worker. Texts with characters whose class could differ between pattern
engines, or with a special token's string, go through the tokenizer whole.

Defined results: a null or empty text is its end id alone. Rows with equal ids are ordered by
a hash of the text and all are written. Null ids come first. An empty table gives no blocks. A very long text is
one document of one block, tokenized whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _text
from ._store import new_path

END_ID = 0
BLOCK_IDS, BLOCK_DOCS = 1 << 19, 1 << 14
CACHE_PIECES = 800_000
SAMPLE = 256


class EliasFano:
    """A non-decreasing sequence of integers in near-minimal space."""

    def __init__(self, n: int, width: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.width = n, width
        self.low, self.high = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8)
        self.samples = np.frombuffer(samples, "<u4")

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.int64)
        n, top = len(v), int(v[-1]) + 1 if len(v) else 1
        width = max(0, (top // max(n, 1)).bit_length() - 1)
        low = ((v[:, None] >> np.arange(width)) & 1).astype(np.uint8)
        ones = (v >> width) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        pack = lambda bits: np.packbits(bits, bitorder="little").tobytes()
        return cls(n, width, pack(low.ravel()), pack(high), ones[::SAMPLE].astype("<u4").tobytes())

    def _low(self, i: np.ndarray) -> np.ndarray:
        at = np.asarray(i, np.int64)[:, None] * self.width + np.arange(self.width)
        return (((self.low[at >> 3] >> (at & 7)) & 1).astype(np.int64) << np.arange(self.width)).sum(axis=1)

    def select(self, i: int) -> int:
        """Value i, reading the unary part from the last sampled one only."""
        place, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, skip = place >> 3, place & 7
        while True:
            bits = np.flatnonzero(np.unpackbits(self.high[byte : byte + 64], bitorder="little")[skip:])
            if left < len(bits):
                return ((byte * 8 + skip + int(bits[left]) - i) << self.width) | int(self._low(np.array([i]))[0])
            left, byte, skip = left - len(bits), byte + 64, 0

    def values(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        return ((ones - np.arange(self.n)) << self.width) | self._low(np.arange(self.n))


# --- pre-tokens -------------------------------------------------------------------------

_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_B = np.arange(256)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[((_B >= 9) & (_B <= 13)) | (_B == 32)] = _SPACE
_CLASS[((_B | 32) >= 97) & ((_B | 32) <= 122) & (_B < 128) | (_B >= 128)] = _LETTER
_CLASS[(_B >= 48) & (_B <= 57)] = _DIGIT
#: Lead bytes 0xC3 to 0xC8 are U+00C0 to U+023F: letters but for the signs for times and division.
_UNSURE = ((_B >= 0x1C) & (_B <= 0x1F)) | (_B >= 0xC9) | (_B == 0xC0) | (_B == 0xC1) | (_B == 0xC2)


def _unsure(t: _text.Texts, specials: list[bytes]) -> np.ndarray:
    """Texts that only the whole tokenizer may cut."""
    d = t.data
    bad = _UNSURE[d]
    bad[:-1] |= (d[:-1] == 0xC3) & ((d[1:] == 0x97) | (d[1:] == 0xB7))
    out = np.zeros(len(t.offsets) - 1, bool)
    out[np.searchsorted(t.offsets, np.flatnonzero(bad), "right") - 1] = True
    whole = d.tobytes()
    for s in specials:
        at = whole.find(s)
        while at >= 0:
            out[np.searchsorted(t.offsets, at, "right") - 1] = True
            at = whole.find(s, at + 1)
    return out


def pieces(t: _text.Texts) -> _text.Words:
    """Where the byte-level pattern cuts: contractions, runs of letters, digits or other signs
    with one space before, and white space."""
    d, n = t.data, len(t.data)
    c = _CLASS[d]
    first = np.zeros(n + 1, bool)
    first[t.offsets] = True
    begin = first[:n].copy()
    begin[1:] |= c[1:] != c[:-1]
    # the last of some white space before a word stands alone; a space joins the word
    last = np.zeros(n, bool)
    last[:-1] = (c[:-1] == _SPACE) & (c[1:] != _SPACE) & ~first[1:n]
    begin |= last
    joined = np.flatnonzero(last & (d == 32)) + 1
    begin[joined] = False
    # 's 't 'm 'd 're 've 'll where a piece begins with the apostrophe
    q = np.flatnonzero((d == 39) & begin)
    ends = t.offsets[np.searchsorted(t.offsets, q, "right")]
    at = lambda j: np.where(q + j < ends, d[np.minimum(q + j, n - 1)], 0)
    a, b = at(1), at(2)
    one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
    two = ((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))
    for where, size in ((q[one], 2), (q[two & ~one], 3)):
        begin[where + 1] = False
        after = where + size
        begin[after[after < n]] = True
    start = np.flatnonzero(begin)
    end = np.append(start[1:], n)
    return _text.Words(start, end, np.searchsorted(start, t.offsets), d)


class Encoder:
    """Token ids of whole texts; keeps the ids of pieces that it has met, in a bounded table."""

    def __init__(self, tokenizer_json: str, cache: int = CACHE_PIECES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.model, self.cache = self.tokenizer.model, cache
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.specials = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.alphabet = {b: chr(256 + i) for i, b in enumerate(hidden)}
        self._clear()

    def _clear(self) -> None:
        self.keys, self.places, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, self.dtype)

    def _learn(self, keys: np.ndarray, texts: list[bytes]) -> None:
        tokenize, alphabet = self.model.tokenize, self.alphabet
        ids = [[x.id for x in tokenize(b.decode("latin-1").translate(alphabet))] for b in texts]
        sizes = np.array([len(x) for x in ids], np.int64)
        places = len(self.pool) + np.cumsum(sizes) - sizes
        self.pool = np.concatenate([self.pool, np.array([i for x in ids for i in x], self.dtype)])
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.places, self.sizes = np.concatenate([self.places, places])[order], np.concatenate([self.sizes, sizes])[order]

    def __call__(self, t: _text.Texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with the end id; how many each has)."""
        n = t.hi - t.lo
        if len(t.data):
            w = pieces(t)
            keys, where, back = np.unique(w.hashes(), return_index=True, return_inverse=True)
            if len(self.keys) > self.cache:
                self._clear()
            at = np.searchsorted(self.keys, keys)
            new = np.ones(len(keys), bool)
            inside = at < len(self.keys)
            new[inside] = self.keys[at[inside]] != keys[inside]
            if new.any():
                d = t.data
                self._learn(keys[new], [d[a:b].tobytes() for a, b in zip(w.start[where[new]].tolist(), w.end[where[new]].tolist(), strict=True)])
                at = np.searchsorted(self.keys, keys)
            at = at[back]
            sizes, places = self.sizes[at], self.places[at]
            sums = np.concatenate([[0], np.cumsum(sizes)])
            ids = self.pool[np.repeat(places - sums[:-1], sizes) + np.arange(sums[-1])]
            edges = sums[w.first]
        else:
            ids, edges = np.zeros(0, self.dtype), np.zeros(n + 1, np.int64)
        unsure = _unsure(t, self.specials)
        if unsure.any():
            own = [np.array(self.tokenizer.encode(t.text(i).decode("utf-8", "replace"), add_special_tokens=False).ids, self.dtype) if unsure[i] else ids[edges[i] : edges[i + 1]] for i in range(n)]
            ids, edges = np.concatenate(own), np.concatenate([[0], np.cumsum([len(x) for x in own])])
        counts = np.diff(edges) + 1
        out = np.full(int(counts.sum()), END_ID, self.dtype)
        keep = np.ones(len(out), bool)
        keep[np.cumsum(counts) - 1] = False
        out[keep] = ids
        return out, counts


_encoder: tuple[int, Encoder] | None = None


def _worker_encoder(tokenizer_json: str) -> Encoder:
    """One per Python worker: its table of pieces outlives a task."""
    global _encoder
    key = zlib.crc32(tokenizer_json.encode())
    if _encoder is None or _encoder[0] != key:
        _encoder = (key, Encoder(tokenizer_json))
    return _encoder[1]


# --- the file format --------------------------------------------------------------------

_BLOCK = "shard int, block int, before long, id_bytes int, doc_ids array<{kind}>, ids binary, n_docs int, low_width int, low binary, high binary, samples binary"


def _write(shared, kind: pa.DataType):
    def block(shard: int, k: int, before: int, names: list[pa.Array], parts: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
        ids, each = np.concatenate(parts), np.concatenate(counts)
        ef = EliasFano.encode(np.concatenate([[0], np.cumsum(each)]))
        row = [[shard], [k], [before], [ids.dtype.itemsize], [pa.concat_arrays(names).to_pylist()], [ids.tobytes()], [len(each)], [ef.width], [ef.low.tobytes()], [ef.high.tobytes()], [ef.samples.tobytes()]]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(kind), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        names_ = [x.split()[0] for x in _BLOCK.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(row, types, strict=True)], names_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, encode = TaskContext.get().partitionId(), _worker_encoder(shared.value)
        k = before = held = 0
        names, parts, counts = [], [], []
        for batch in batches:
            for t in _text.split_texts(batch.column(1), 500_000):
                ids, each = encode(t)
                names.append(batch.column(0).slice(t.lo, t.hi - t.lo).cast(kind))
                parts.append(ids)
                counts.append(each)
                held += len(ids)
                if held >= BLOCK_IDS or sum(map(len, counts)) >= BLOCK_DOCS:
                    yield block(shard, k, before, names, parts, counts)
                    k, before, held = k + 1, before + held, 0
                    names, parts, counts = [], [], []
        if parts:
            yield block(shard, k, before, names, parts, counts)

    return run


def write(documents: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> None:
    """Tokenize all documents and write their ids to `path`, in ascending order of ids."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(Path(tokenizer_path).read_text(encoding="utf-8"))
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    field = documents.schema[id_col]
    kind = documents.select(id_col).limit(0).toArrow().schema.field(0).type
    docs = documents.select(F.col(id_col), F.col(text_col).alias("text"))
    tie = F.xxhash64("text")
    dealt = docs.repartitionByRange(shards, F.col(id_col), tie).sortWithinPartitions(F.col(id_col), tie)
    dealt.mapInArrow(_write(shared, kind), _BLOCK.format(kind=field.dataType.simpleString())).write.option("compression", "zstd").parquet(path)


def _read(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        global _encoder
        _encoder = None  # reading needs none; its table would stay with the worker
        _text.release_memory()
        for batch in batches:
            for row in range(batch.num_rows):
                b = {c: batch.column(c)[row].as_py() for c in ("base", "before", "id_bytes", "ids", "n_docs", "low_width", "low", "high", "samples")}
                ids = np.frombuffer(b["ids"], f"<u{b['id_bytes']}")
                at = EliasFano(b["n_docs"] + 1, b["low_width"], b["low"], b["high"], b["samples"]).values()
                each = [ids[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_ids")[row].values, pa.array(b["base"] + b["before"] + at[:-1]), pa.array(np.diff(at)), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in each], pa.int64())],
                    [name, "start", "n_tokens", "ids_crc32"],
                )

    return run


def read(spark, path: str, id_col: str = "doc_id") -> DataFrame:
    """From the files: id, start, n_tokens, ids_crc32 of each document.

    The only table that is broadcast has one row per shard, a number that `write` was given.
    """
    blocks = spark.read.parquet(path)
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    totals = blocks.groupBy("shard").agg(F.max(F.col("before") + F.length("ids") / F.col("id_bytes")).cast("long").alias("total"))
    bases = totals.select("shard", (F.sum("total").over(W.orderBy("shard")) - F.col("total")).alias("base"))
    return blocks.join(F.broadcast(bases), "shard").mapInArrow(_read(id_col), f"`{id_col}` {kind}, start long, n_tokens long, ids_crc32 long")


def round_trip(documents: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files in the shared folder and read them back."""
    path = new_path(documents.sparkSession, "tokens")
    write(documents, path, tokenizer_path, id_col, text_col)
    return read(documents.sparkSession, path, id_col)

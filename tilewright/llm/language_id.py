"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. A trigram's vector
binds its letters: the first permuted twice, the second once, multiplied elementwise. A text
bundles its trigrams' vectors, each weighted by ln(1 + count); a language bundles its texts'
unit vectors. A text goes to the language whose prototype, less the mean of all prototypes, has
the largest cosine with it; the score is the softmax of these cosines.

Prototypes are fitted on a bounded sample, about `per_language` labelled texts of each language (a
hash of id and text chooses them); what reaches the driver is one vector per language. Prediction
runs over every whole text.

Defined results: a null text or one without a letter is `und` with score 0. Without any
labelled text every text is `und`. A null id counts as the empty text for the folds, so such rows are held out; each is predicted. Repeated
rows are repeated in the result. An empty table gives an empty result. `accepted` decides row by row, by the text alone. A very long text is
handled whole, in memory of some tens of bytes a character. Bytes that are not UTF-8 are signs without letters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text

DIMENSIONS, PER_LANGUAGE, SHARPNESS = 1024, 5_000, 12.0
KEPT_TRIGRAMS, BLOCK = 40_000, 2048
UNKNOWN = "und"
_GAP = 0x20

_folded: np.ndarray | None = None


def _fold() -> np.ndarray:
    """Code point to its lower-case letter, or a gap."""
    global _folded
    if _folded is None:
        out = np.full(0x110000, _GAP, np.uint32)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                out[c] = ord(low) if len(low) == 1 else c
        _folded = out
    return _folded


class Trigrams:
    """Vectors of trigrams, made once each and kept in a bounded table."""

    def __init__(self, dimensions: int):
        self.d, self.letters = dimensions, {}
        self._clear()

    def _clear(self) -> None:
        self.keys, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.table = np.empty((KEPT_TRIGRAMS, self.d), np.int8)  # pages are taken as rows are filled

    def _letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            self.letters[code] = np.random.default_rng([20, code]).integers(0, 2, self.d, dtype=np.int8) * 2 - 1
        return self.letters[code]

    def vectors(self, keys: np.ndarray) -> np.ndarray:
        """Rows for at most BLOCK sorted distinct keys."""
        if len(self.keys) + BLOCK > KEPT_TRIGRAMS:
            self._clear()
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        fresh = keys[~known]
        if len(fresh):
            used = len(self.keys)
            for i, k in enumerate(fresh.tolist()):
                a, b, c = k >> 42, (k >> 21) & 0x1FFFFF, k & 0x1FFFFF
                self.table[used + i] = np.roll(self._letter(a), 2) * np.roll(self._letter(b), 1) * self._letter(c)
            rows = np.concatenate([self.rows, used + np.arange(len(fresh))])
            merged = np.concatenate([self.keys, fresh])
            order = np.argsort(merged, kind="stable")
            self.keys, self.rows = merged[order], rows[order]
            at = np.searchsorted(self.keys, keys)
        return self.table[self.rows[at]]

    def bundle(self, t: _text.Texts) -> np.ndarray:
        """Unit vectors of texts, one a row; zero for a text without letters."""
        fold, found = _fold(), []
        for i in range(t.hi - t.lo):
            codes = np.frombuffer(t.text(i).decode("utf-8", "replace").encode("utf-32-le"), "<u4")
            x = np.concatenate([[_GAP], fold[codes], [_GAP]]).astype(np.uint64)
            mid = x[1:-1] != _GAP
            key = (x[:-2] << np.uint64(42)) | (x[1:-1] << np.uint64(21)) | x[2:]
            found.append(np.unique(key[mid], return_counts=True))
        every, back = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
        weights = np.zeros((len(found), len(every)), np.float32)
        at = 0
        for i, (k, n) in enumerate(found):
            weights[i, back[at : at + len(k)]] = np.log1p(n)
            at += len(k)
        out = np.zeros((len(found), self.d), np.float32)
        for lo in range(0, len(every), BLOCK):
            out += weights[:, lo : lo + BLOCK] @ self.vectors(every[lo : lo + BLOCK]).astype(np.float32)
        norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


_trigrams: Trigrams | None = None


def _worker_trigrams(d: int) -> Trigrams:
    global _trigrams
    if _trigrams is None or _trigrams.d != d:
        _trigrams = Trigrams(d)
    return _trigrams


def _learn(d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            lang = np.array(batch.column(1).to_pylist(), object)
            for t in _text.split_texts(batch.column(0), 300_000):
                v = _worker_trigrams(d).bundle(t)
                for x in set(lang[t.lo : t.hi]):
                    sums[x] = sums.get(x, np.zeros(d)) + v[lang[t.lo : t.hi] == x].sum(axis=0)
        for x, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([x] * d), pa.array(np.arange(d), pa.int32()), pa.array(v)], ["lang", "dim", "value"])

    return run


def prototypes(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int = PER_LANGUAGE, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """(languages, centred unit prototypes) from labelled texts."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}  # one row per language
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, per_language / n)]) if counts else F.lit(None).cast("map<string,double>")
    draw = F.pmod(F.xxhash64(F.lit("language"), F.col(id_col), F.col(text_col)), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(draw < share[F.col(lang_col)]).select(F.col(text_col), F.col(lang_col))
    sums = sample.mapInArrow(_learn(dimensions), "lang string, dim int, value double").groupBy("lang", "dim").agg(F.sum("value").alias("value")).collect()
    names = sorted({r["lang"] for r in sums})
    table = np.zeros((len(names), dimensions))
    for r in sums:
        table[names.index(r["lang"]), r["dim"]] = r["value"]
    unit = lambda m: m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-12)
    table = unit(table)
    if len(names) > 1:
        table = unit(table - table.mean(axis=0))
    return names, table.astype(np.float32)


def _assign(shared, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = shared.value
        for batch in batches:
            for t in _text.split_texts(batch.column(1), 300_000):
                n = t.hi - t.lo
                v = _worker_trigrams(table.shape[1]).bundle(t)
                some = v.any(axis=1) if names else np.zeros(n, bool)
                best, score = np.zeros(n, np.int64), np.zeros(n)
                if names:
                    z = np.exp(SHARPNESS * (v @ table.T).astype(np.float64))
                    best, score = z.argmax(axis=1), z.max(axis=1) / z.sum(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(t.lo, n), pa.array([names[b] if s else UNKNOWN for b, s in zip(best, some, strict=True)], pa.string()), pa.array(np.where(some, score, 0.0))],
                    [name, "lang_pred", "score"],
                )

    return run


def predict(documents: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: id, lang_pred, score."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kind = documents.schema[id_col].dataType.simpleString()
    return documents.select(F.col(id_col), F.col(text_col)).mapInArrow(_assign(shared, id_col), f"`{id_col}` {kind}, lang_pred string, score double")


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """Whether a row is kept from learning: crc32 of its id as text, modulo `folds`, is 0."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == 0


def identify(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the rows that are not held out, predict all: id, held_out, lang_pred, score."""
    model = prototypes(documents.where(~held_out(id_col)), id_col, text_col, lang_col)
    return predict(documents, model, id_col, text_col).select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")


def accepted(documents: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", least_score: float = 0.3) -> DataFrame:
    """The rows, with all their columns, whose text has a language with at least `least_score`; one pass, no shuffle."""
    shared, place = documents.sparkSession.sparkContext.broadcast(model), documents.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assign = _assign(shared, "i")
        for batch in batches:
            own = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(place)], ["i", "t"])
            for got in assign([own]):
                ok = (got.column("score").to_numpy() >= least_score) & np.array([x != UNKNOWN for x in got.column("lang_pred").to_pylist()], bool)
                yield batch.take(got.column("i").filter(pa.array(ok)))

    return documents.mapInArrow(run, documents.schema)

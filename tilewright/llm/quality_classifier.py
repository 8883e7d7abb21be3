"""Quality classifier from positive and unlabelled texts.

A linear model over word shapes and text statistics minimises the non-negative unbiased risk

    prior * E_pos[loss(f)] + max(0, E_unl[loss(-f)] - prior * E_pos[loss(-f)])

with the logistic loss: trusted positives are texts labelled good, unlabelled ones are a draw
from all texts. When the second part falls below zero its gradient is reversed, which keeps the
model from fitting the positives it has seen. The class prior is estimated from positives and unlabelled texts alone: a
classifier of the one against the other is fitted on half of them, and on the other half the prior is the least ratio
of the shares that score at least a threshold, unlabelled over positive, the threshold being chosen with an allowance
for the size of the samples (best-bin estimate). Negative labels are never read.

Fitting uses about `sample` positives and `sample` unlabelled texts (a hash of id and text chooses
them), so the driver holds two small matrices of fixed width. Scoring runs over every whole text.

Defined results: null and empty texts have all-zero features and the score that these get.
Without trusted positives every score is one half. Null ids have no label, and each such row is scored. Repeated rows are repeated in the result; repeated
labels of an id count once, and a document is positive if any says so. An empty table gives an empty result. A very long text is
handled whole, in memory of some tens of bytes a byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._store import small
from .quality_rules import _repeats

SAMPLE, STEPS, RATE, DECAY = 10_000, 400, 0.05, 1e-4
#: Chance that the allowance for the samples of the prior fails, and its weight.
DELTA, GAMMA = 0.1, 0.01
#: Byte classes: white space, small letter (or beyond ASCII), capital, digit, sentence mark, other sign.
_B = np.arange(256)
_CLASS = np.full(256, 5, np.int64)
_CLASS[~_text.NOT_SPACE] = 0
_CLASS[((_B >= 97) & (_B <= 122)) | (_B >= 128)] = 1
_CLASS[(_B >= 65) & (_B <= 90)] = 2
_CLASS[(_B >= 48) & (_B <= 57)] = 3
_CLASS[np.isin(_B, np.frombuffer(b".,;:'\"-()", np.uint8))] = 4
SHAPES = 6**3
#: Upper ends of the bins of the share of repeated words; lengths fall into bins by their power of two.
REPEAT_BINS = np.array([0.0, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75])
LENGTH_BINS, STATISTICS = 16, 12
FEATURES = SHAPES + STATISTICS + len(REPEAT_BINS) + 1 + LENGTH_BINS


def features(t: _text.Texts) -> np.ndarray:
    """One row per text: square roots of the shares of word shapes (first and last two bytes), statistics,
    and bins of two of them."""
    w = _text.words_of(t, _text.NOT_SPACE)
    n, counts = t.hi - t.lo, w.counts
    out = np.zeros((n, FEATURES))
    owner = np.repeat(np.arange(n), counts)
    c = _CLASS[t.data]
    if len(w.start):
        last = w.end - 1
        before = np.maximum(last - 1, w.start)
        shape = (c[w.start] * 6 + c[before]) * 6 + c[last]
        out[:, :SHAPES] = np.bincount(owner * SHAPES + shape, minlength=n * SHAPES).reshape(n, SHAPES)
    words = np.maximum(counts, 1)[:, None]
    out[:, :SHAPES] = np.sqrt(out[:, :SHAPES] / words)
    size = np.diff(t.offsets)
    each = np.zeros((6, n))
    for k in range(6):
        each[k] = np.diff(np.concatenate([[0], np.cumsum(c == k)])[t.offsets])
    lines = np.diff(np.concatenate([[0], np.cumsum(t.data == 10)])[t.offsets])
    repeats = _repeats(w)
    chars = np.maximum(size, 1)
    stats = [
        np.log1p(counts) / 5,
        counts > 0,
        *np.sqrt(each[1:] / chars),
        size / words[:, 0] / 10,
        np.sqrt(lines / words[:, 0]),
        np.sqrt(repeats / words[:, 0]),
        np.sqrt(each[5] / words[:, 0]),
        np.sqrt(each[2] / words[:, 0]),
    ]
    out[:, SHAPES : SHAPES + STATISTICS] = np.stack(stats, axis=1)
    at, row = SHAPES + STATISTICS, np.arange(n)
    out[row, at + np.searchsorted(REPEAT_BINS, repeats / words[:, 0])] = 1
    at += len(REPEAT_BINS) + 1
    out[row, at + np.minimum(np.log2(counts + 1).astype(int), LENGTH_BINS - 1)] = 1
    return out


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for t in _text.split_texts(batch.column(0)):
            x = features(t).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), batch.column(1).slice(t.lo, t.hi - t.lo)], ["x", "positive"])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit(pos: np.ndarray, unl: np.ndarray, prior: float | None, steps: int = STEPS, rate: float = RATE, decay: float = DECAY) -> tuple[np.ndarray, float]:
    """(weights, bias) of the non-negative risk's minimiser, by Adam on all rows; without a prior, of telling `pos` from `unl`."""
    both = np.concatenate([pos, unl])
    mean, sd = both.mean(axis=0), np.maximum(both.std(axis=0), 0.02)
    p, u = (pos - mean) / sd, (unl - mean) / sd
    theta, m, v = np.zeros(p.shape[1] + 1), np.zeros(p.shape[1] + 1), np.zeros(p.shape[1] + 1)
    theta[-1] = np.log(prior / (1 - prior)) if prior else 0.0
    back = lambda x, g: np.append(x.T @ g, g.sum()) / len(g)
    for step in range(1, steps + 1):
        fp, fu = p @ theta[:-1] + theta[-1], u @ theta[:-1] + theta[-1]
        if prior:
            negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
            good = prior * back(p, _sigmoid(fp) - 1)
            bad = back(u, _sigmoid(fu)) - prior * back(p, _sigmoid(fp))
            g = good + bad if negative >= 0 else -bad
        else:
            g = (back(p, _sigmoid(fp) - 1) + back(u, _sigmoid(fu))) / 2
        g[:-1] += decay * theta[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    w = theta[:-1] / sd
    return w, float(theta[-1] - mean @ w)


def estimated_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """The share of positives among unlabelled rows; within 0.01 and 0.99, one half for too few rows."""
    if min(len(pos), len(unl)) < 20:
        return 0.5
    w, b = fit(pos[::2], unl[::2], None, steps=STEPS // 2)
    p, u = np.sort(pos[1::2] @ w + b), np.sort(unl[1::2] @ w + b)
    above_p = 1 - np.searchsorted(p, p) / len(p)  # at each positive's score as threshold
    above_u = 1 - np.searchsorted(u, p) / len(u)
    slack = sum(np.sqrt(np.log(4 / DELTA) / (2 * len(x))) for x in (p, u))
    best = np.argmin((above_u + (1 + GAMMA) * slack) / above_p)
    return float(np.clip(above_u[best] / above_p[best], 0.01, 0.99))


def train(labelled: DataFrame, documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Model from `labelled` (id, label; only rows that may be learned from, of which those with label 1 are used) and all `documents`."""
    positive = labelled.where((F.col(label_col) == 1) & F.col(id_col).isNotNull()).select(id_col).distinct()
    good, every = positive.count(), documents.count()
    nothing = np.zeros(FEATURES), 0.0
    if not good or not every:
        return nothing
    draw = lambda salt, *c: F.pmod(F.xxhash64(F.lit(salt), *c), F.lit(1 << 30)) / float(1 << 30)
    texts = documents.select(F.col(id_col), F.col(text_col))
    pos = small(positive.where(draw("positive", id_col) < sample / good))  # about `sample` ids
    pos = texts.join(pos, id_col, "left_semi").select(text_col, F.lit(True).alias("positive"))
    unl = texts.where(draw("unlabelled", id_col, text_col) < sample / every).select(text_col, F.lit(False).alias("positive"))
    got = pos.unionAll(unl).mapInArrow(_feature_rows, "x binary, positive boolean").toArrow()
    x = np.array([np.frombuffer(b.as_buffer(), np.float32) for b in got.column("x")], np.float32).reshape(-1, FEATURES).astype(np.float64)
    is_pos = np.asarray(got.column("positive").to_pylist(), bool)
    if not is_pos.any() or is_pos.all():
        return nothing
    # an order of their own, whatever tasks they came from
    pos, unl = (y[np.lexsort(y.T[::-1])] for y in (x[is_pos], x[~is_pos]))
    shuffled = lambda y: y[np.random.default_rng(len(y)).permutation(len(y))]
    pos, unl = shuffled(pos), shuffled(unl)
    return fit(pos, unl, estimated_prior(pos, unl))


def score(documents: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: id, score."""
    weights, bias = model

    def run(batches: Iterator[pa.RecordBatch], name: str = id_col) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in _text.split_texts(batch.column(1)):
                z = features(t) @ weights + bias
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(t.lo, t.hi - t.lo), pa.array(_sigmoid(z))], [name, "score"])

    kind = documents.schema[id_col].dataType.simpleString()
    return documents.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, score double")

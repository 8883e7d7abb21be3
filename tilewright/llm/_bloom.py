"""A Bloom filter over 64-bit hashes, of a size that its caller bounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text


def _places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    a = _text.mix(h ^ np.uint64(0xA5A5A5A55A5A5A5A))
    b = _text.mix(h ^ np.uint64(0x5A5A5A5AA5A5A5A5))
    return (a & np.uint64(bits - 1)).astype(np.int64), (b & np.uint64(bits - 1)).astype(np.int64)


def size_for(n: int, least: int = 1 << 20, most: int = 1 << 29) -> int:
    """Bits, a power of two: 16 a value, from `least` to `most`. A fuller filter only lets more pass."""
    bits = least
    while bits < 16 * n and bits < most:
        bits *= 2
    return bits


def build(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """The filter's bytes. Rows that reach the driver: bits / 64 at most, whatever the input."""

    def positions(batches):
        for batch in batches:
            a, b = _places(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits)
            at = np.unique(np.concatenate([a, b]))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(at & 63, pa.int32())], ["word", "bit"])

    got = df.select(column).mapInArrow(positions, "word long, bit int").groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()
    out = np.zeros(bits >> 6, np.int64)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return out.view(np.uint8)


def passes(filter_bytes: np.ndarray, h: np.ndarray) -> np.ndarray:
    a, b = _places(h, len(filter_bytes) * 8)
    one = filter_bytes[a >> 3] >> (a & 7).astype(np.uint8)
    return (one & (filter_bytes[b >> 3] >> (b & 7).astype(np.uint8)) & 1).astype(bool)

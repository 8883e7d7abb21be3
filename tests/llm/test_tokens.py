import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tilewright.llm import _text, token_output
from tilewright.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenizer_path())


def plain(tokenizer, docs):
    """Ids of each document by the whole tokenizer, in ascending order of ids, nulls first."""
    out, start = [], 0
    for d, t in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_pieces_equal_the_whole_tokenizer(tokenizer):
    rng = random.Random(5)
    signs = "aAzZ s'tredvlm'' \n\t  éßñ×÷1 9.,!<|>#\r\x0b\x0c\x1c\x1f\x85\xa0中~ĪɎ😀"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["don't we'll they've I'M 'tis it's 'r 're 'v", None, "", "<|endoftext|> a<|endoftext|>", " 's \n's x's", "\n\n  a", "  ", "'", "'s"]
    encode = token_output.Encoder(open(tokenizer_path(), encoding="utf-8").read(), cache=500)
    for t in _text.split_texts(pa.array(texts, pa.string()), 3000):
        ids, counts = encode(t)
        at = np.concatenate([[0], np.cumsum(counts)])
        for i in range(t.hi - t.lo):
            assert ids[at[i] : at[i + 1]].tolist() == [*tokenizer.encode(texts[t.lo + i] or "", add_special_tokens=False).ids, 0], texts[t.lo + i]


@pytest.mark.parametrize("n", [1, 2, 255, 256, 257, 5000])
def test_elias_fano(n):
    for spread in (0, 1, 37, 10**6):
        v = np.sort(np.random.default_rng(n).integers(0, n * spread + 1, n))
        e = token_output.EliasFano.encode(v)
        assert (e.values() == v).all()
        assert all(e.select(i) == v[i] for i in range(0, n, max(1, n // 300)))
    assert len(e.low) + len(e.high) <= n * (2 + np.log2(10**6)) / 8 + 16


def test_round_trip(spark, documents, tokenizer, pairs, monkeypatch):
    got = token_output.round_trip(documents, tokenizer_path()).collect()
    assert sorted(map(tuple, got)) == plain(tokenizer, pairs(documents))


def test_odd_documents(odd, unnamed, nothing, tokenizer, pairs):
    for df in (odd, unnamed):
        got = sorted((tuple(r) for r in token_output.round_trip(df, tokenizer_path()).collect()), key=lambda r: r[1])
        want = plain(tokenizer, pairs(df))
        assert [r[0] for r in got] == [r[0] for r in want]
        assert sorted((str(r[0]), r[2], r[3]) for r in got) == sorted((str(r[0]), r[2], r[3]) for r in want)
        assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:]))
    assert token_output.round_trip(nothing, tokenizer_path()).collect() == []


def test_small_blocks(spark, documents, tokenizer, pairs, tmp_path):
    path = str(tmp_path / "t")
    token_output.write(documents, path, tokenizer_path(), shards=3)
    blocks = spark.read.parquet(path).select("shard", "block", "n_docs", "id_bytes").collect()
    assert {b["id_bytes"] for b in blocks} == {2} and sum(b["n_docs"] for b in blocks) == documents.count()
    assert sorted(map(tuple, token_output.read(spark, path).collect())) == plain(tokenizer, pairs(documents))

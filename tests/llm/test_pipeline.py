import brute

import __spark_entry__
import corpus_pipeline
from tilewright.llm import minhash_dedup, mixing


def test_stages_take_effect(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, "en", "src0", 0), (10**6 + 1, "123 456", "en", "src0", 7)], docs.schema)
    item = spark.read.parquet(f"{small}/benchmark.parquet").first()["text"]
    extra = extra.unionAll(spark.createDataFrame([(10**6 + 2, f"Then came {item}", "en", "src0", 9)], docs.schema))
    now, kept = docs.unionAll(extra), {}
    for name, stage in corpus_pipeline.STAGES:
        before = now
        now = stage(spark, now, small).cache()
        kept[name] = now
        if name != "token_output":
            assert now.columns == docs.columns
        if name == "near_dedup":
            texts = [(r["doc_id"], r["text"]) for r in before.select("doc_id", "text").collect()]
            assert sorted(r["doc_id"] for r in now.collect()) == [x[0] for x in brute.op2(texts) if x[3]]
    ids = {n: {r["doc_id"] for r in df.select("doc_id").collect()} for n, df in kept.items()}
    assert not ids["language_id"] & {10**6, 10**6 + 1} and 10**6 + 2 in ids["near_dedup"]
    assert 10**6 + 2 not in ids["decontamination"]
    assert ids["mixing"] <= ids["decontamination"] and ids["token_output"] == ids["mixing"]
    assert kept["token_output"].count() == kept["mixing"].count()


def stages(spark, small, docs):
    """Each stage's rows, with what it got."""
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, stage(spark, now, small).cache()
        yield name, before, now


def test_stages_equal_plain_versions(spark, small, odd, unnamed, nothing):
    """Null and repeated ids, exact repeats, empty texts, clashing columns, an empty table; each stage is judged on its own input."""
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    texts = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=str)
    hit = next(t for _, t in items if len(t.split()) > 9)
    extra = [(None, f"Then came {hit}", "en", "s1"), (2, f"Then came {hit}", "en", None), (2, "something else altogether", "en", "s0"), (None, "a null id and a clean text", "fr", "s0")]
    for df in (odd, unnamed, nothing):
        if df is not nothing:
            more = spark.createDataFrame(extra, "doc_id long, text string, lang string, source string")
            df = df.unionByName(more, allowMissingColumns=True)
        for name, before, now in stages(spark, small, df):
            had = texts(before)
            if name != "token_output":
                assert now.columns == df.columns
            if name == "language_id":
                assert all(any(c.isalpha() for c in t or "") for _, t in texts(now))
                assert {t for _, t in had if t and "clean text" in t} <= {t for _, t in texts(now)}
            elif name == "near_dedup":
                sets = brute.op2([(i, t) for i, (_, t) in enumerate(had)])
                assert now.count() == sum(r[3] for r in sets)  # one of each class, whatever its ids
            elif name == "decontamination":
                assert texts(now) == [(d, t) for d, t in had if not brute.op9([(0, t)], items)[0][2]]
            elif name == "mixing":
                taken = {}
                for r in mixing.mix(before).where("size > 0").collect():
                    n, size = taken.get(r["doc_id"], (0, 0))
                    taken[r["doc_id"]] = n + r["taken"], size + r["size"]
                ids = [d for d, _ in texts(now)]
                unique = [d for d, _ in had if d is not None and sum(x == d for x, _ in had) == 1]
                assert all(ids.count(d) == int(taken[d][0] / taken[d][1] + 0.5) for d in unique if d in taken)
            else:
                assert now.count() == before.count()
                got = sorted((r["start"], r["n_tokens"]) for r in now.collect())
                assert all(a + n == b for (a, n), (b, _) in zip(got, got[1:]))


def test_registered(spark):
    names = list(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert corpus_pipeline.ORACLE_SQL is None and minhash_dedup.BINS % minhash_dedup.ROWS == 0

"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Sources in code point order (null last) weigh 5, 2, 1, repeating. Targets share all words by
weight; none exceeds `max_repeats` times its source, the excess being shared again by weight
until none is above: the level of words a unit of weight rises, one aggregate over the sources a time, until no further
source reaches its cap. Words are dealt in blocks of equal size, a sixteenth of the
smallest target at most, so that every source comes within a few hundredths of its target.

Blocks go to sources by highest quotients target / (2k + 1), then to the shards of each source
likewise by the shards' words. The winners are found without listing all quotients: with n
claimants and N seats, a claimant's seats lie between those at the levels total / (N - n/2) and
total / (N + n/2), so about 2n quotients are ranked, however many blocks there are. A shard
(about 5,000 documents at most, by a hash of the id) lays its documents end to end in a seeded
order and takes its blocks from the front, wholly round as often as they reach: no document
exceeds `max_repeats` times its size. Only DataFrame operations; the largest sort group is one
shard, so a hot source is many groups. Sources may be many: up to `ONE_TASK` rows of sources or quotients (counted) are ranked by
one task, more in sorted ranges that are each numbered from the rows before. The shards of one source, one row for 5,000 documents, are
ranked together.

`mixed` does not move texts: each shard is cut at one place of its seeded order, so a document needs only its shard's
row of a small table.

Defined results: null texts and texts without words have size 0 and are never taken; sources without words have target
0. Rows with equal ids are mixed as separate rows, in the order of their sizes; in `mixed` those of a shard's cut are taken equally often. A null id is
drawn by its text, so such rows spread over shards; equal ones are separate rows. An empty table
gives an empty mix. A very long text is counted whole by one expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._store import materialize, small

WEIGHTS, MAX_REPEATS, SEED = (5, 2, 1), 3, "mix-1"
SHARD_DOCS, BLOCK_WORDS = 5_000, 1024
#: Rows that a single task may sort.
ONE_TASK = 100_000


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def numbered(df: DataFrame, order: list, name: str, most: int = ONE_TASK) -> DataFrame:
    """Adds `name`: 1, 2, 3 along `order`, which has no ties."""
    if df.count() <= most:
        return df.withColumn(name, F.row_number().over(W.orderBy(*order)).cast("long"))
    laid = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    laid = materialize(laid, "ranges")
    sizes, before = sorted(map(tuple, laid.groupBy("_range").count().collect())), 0  # one row per partition
    base = []
    for part, n in sizes:
        base += [F.lit(part), F.lit(before)]
        before += n
    return laid.withColumn(name, F.element_at(F.create_map(*base), F.col("_range")) + F.col("_at") + 1).drop("_range", "_at")


def apportion(claims: DataFrame, within: list[str], votes: str, seats: str, order: list[str], most: int = ONE_TASK) -> DataFrame:
    """Adds `quota`: Sainte-Lague seats of each row among the rows with equal `within`.

    `seats` is a column that is constant within them. Ties go by `order`. Keys are not null.
    """
    v, s = F.col(votes), F.col(seats)
    if within:
        part = W.partitionBy(*within)
        over = lambda c: c.over(part)
    else:
        part = None
        over = lambda c: F.lit(claims.agg(c).first()[0])
    total, n = over(F.sum(v)), over(F.sum((v > 0).cast("long")))
    at = lambda level: F.when(v > 0, F.floor(v * level / total + 0.5)).otherwise(0).cast("long")
    bounds = claims.withColumn("_lo", F.greatest(at(s - n / 2) - 1, F.lit(0).cast("long"))).withColumn("_hi", at(s + n / 2) + 1)
    left = F.sum("_lo").over(part) if within else F.lit(bounds.agg(F.sum("_lo")).first()[0])
    bounds = bounds.withColumn("_left", s - left)
    keys = [*within, *order]
    ranked = bounds.where(v > 0).select(*keys, "_left", v.alias("_v"), F.explode(F.sequence(F.col("_lo"), F.col("_hi"))).alias("_k"))
    ranked = ranked.withColumn("_q", F.col("_v") / (2 * F.col("_k") + 1))
    line = [F.desc("_q"), *order]
    ranked = ranked.withColumn("_place", F.row_number().over(part.orderBy(*line))) if within else numbered(ranked, line, "_place", most)
    won = ranked.where(F.col("_place") <= F.col("_left")).groupBy(*keys).agg(F.count("*").alias("_won"))
    return bounds.join(won, keys, "left").select(*claims.columns, (F.col("_lo") + F.coalesce("_won", F.lit(0))).alias("quota"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, most: int = ONE_TASK) -> DataFrame:
    """One row per source: idx, source, docs, source_size, target, block, blocks."""
    table = materialize(sizes.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"), F.col("source").isNull().alias("_unknown")), "source_sizes")
    table = numbered(table, ["_unknown", "source"], "idx", most).withColumn("idx", F.col("idx") - 1)
    table = table.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("idx") % len(weights) + 1).cast("int")).cast("double"))
    table = materialize(table, "weighted_sources")
    cap, weight = (F.col("source_size") * max_repeats).cast("double"), F.col("weight")
    words, every = table.agg(F.sum("source_size"), F.sum("weight")).first()
    level, before = (words / every if words else 0.0), None
    while level != before:
        before = level
        capped, light = table.where(cap / weight < level).agg(F.sum(cap), F.sum("weight")).first()
        if light and light < every:
            level = (words - capped) / (every - light)
    target = F.least(cap, weight * level)
    least = table.agg(F.min(F.when(target > 0, target))).first()[0]
    block = max(1, min(BLOCK_WORDS, int(least // 16))) if least else 1
    return table.select("idx", "source", "docs", "source_size", target.alias("target"), F.lit(block).cast("long").alias("block"), F.lit((words or 0) // block).cast("long").alias("blocks"))


def _draw(seed: str, id_: Column, text: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))).cast("binary"))


def _shard(draw: Column, docs: Column) -> Column:
    return F.conv(F.substring(draw, 1, 8), 16, 10).cast("long") % F.ceil(docs / SHARD_DOCS)


def _laid(documents: DataFrame, id_col: str, text_col: str, source_col: str, seed: str, most: int) -> tuple[DataFrame, DataFrame]:
    """(rows with id, size, draw, idx, shard, rounds, taken and their source's columns; sources with idx)."""
    sizes = documents.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"), _draw(seed, F.col(id_col), F.col(text_col)).alias("draw"))
    sizes = materialize(sizes, "sizes")
    claims = targets(sizes, most=most)
    sources = materialize(apportion(claims, [], "target", "blocks", ["idx"], most).withColumnRenamed("quota", "source_blocks"), "sources")

    dealt = sizes.withColumnRenamed("source", "own_source").join(small(sources), F.col("own_source").eqNullSafe(F.col("source")))
    dealt = dealt.withColumn("shard", _shard(F.col("draw"), F.col("docs")))
    claims = dealt.groupBy("idx", "source_blocks", "block", "shard").agg(F.sum("size").alias("words"))
    claims = apportion(claims.withColumn("votes", F.col("words").cast("double")), ["idx"], "votes", "source_blocks", ["shard"])
    quota = claims.select(F.col("idx").alias("q_idx"), F.col("shard").alias("q_shard"), "words", F.least(F.col("quota") * F.col("block"), F.col("words") * MAX_REPEATS).alias("quota"))

    got = dealt.join(quota, (F.col("idx") == F.col("q_idx")) & (F.col("shard") == F.col("q_shard")))
    before = F.sum("size").over(W.partitionBy("idx", "shard").orderBy("draw", "id", "size").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    rounds = F.when(F.col("words") > 0, F.floor(F.col("quota") / F.col("words"))).otherwise(0).cast("long")
    got = got.withColumn("before", before).withColumn("rounds", rounds).withColumn("rest", F.col("quota") - F.col("rounds") * F.col("words"))
    taken = F.col("rounds") * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("rest") - F.col("before"), F.col("size")))
    return got.withColumn("taken", taken), sources


def mix(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, most: int = ONE_TASK) -> DataFrame:
    """One row per document row: id, size, source_size, target, taken."""
    got, _ = _laid(documents, id_col, text_col, source_col, seed, most)
    return got.select(F.col("id").alias(id_col), "size", "source_size", "target", "taken")


def mixed(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """The rows, with all their columns, as often as the mix takes them.

    Documents stay whole: of each shard at most one is taken in part, and its share is rounded.
    """
    got, sources = _laid(documents, id_col, text_col, source_col, seed, ONE_TASK)
    times = F.floor(F.col("taken") / F.col("size") + 0.5)
    cuts = got.where("size > 0").groupBy("idx", "shard").agg(F.first("rounds").cast("int").alias("_rounds"), F.max(F.when(times > F.col("rounds"), F.col("draw"))).alias("_cut"))
    cuts = small(materialize(cuts.select(F.col("idx").alias("_cut_idx"), F.col("shard").alias("_cut_shard"), "_rounds", "_cut"), "shard_cuts"))
    known = small(sources.select(F.col("idx").alias("_idx"), F.col("source").alias("_source"), F.col("docs").alias("_docs")))
    text = documents[text_col]
    rows = documents.where(text.rlike(r"[^\x20\x09-\x0D]")).withColumn("_draw", _draw(seed, documents[id_col], text))
    rows = rows.join(known, documents[source_col].eqNullSafe(known["_source"])).withColumn("_shard", _shard(F.col("_draw"), F.col("_docs")))
    rows = rows.join(cuts, (F.col("_idx") == F.col("_cut_idx")) & (F.col("_shard") == F.col("_cut_shard")))
    copies = F.col("_rounds") + F.coalesce((F.col("_draw") <= F.col("_cut")).cast("int"), F.lit(0))
    return rows.select(*documents.columns, F.explode(F.array_repeat(F.lit(0), copies)).alias("_copy")).select(*documents.columns)

"""License scans: MinHash bands over overlapping windows, then exact shingle containment.

A text's words are its lower-cased runs of letters and digits. Windows are eight words long and
start at every fourth word; templates have a window at every word. A window's shingles are its
pairs of neighbours. Sixteen hashes, each xxhash64 of the pair's hash under its own mask, are minimised over a
window, each a band of one row, and a window is a candidate if three bands meet those of one
template's window set. A notice of five words or more lies wholly in one window or fills one, so
it shares J = 4/7 of its pairs or more: three of sixteen meet with a probability of 0.9997, and
long templates have many windows. A window with one common pair seldom has three. Templates of
fewer than five words are too small for that: their pairs are looked up by themselves, so each
window with one of them is met, and a text is a candidate if it has as many of them as
`containment` asks for. Candidates
are verified by exact strings: the share of the template's
pairs that the text around the window holds must reach `containment`. That alone takes 'CC BY-NC'
for 'CC BY' too, as only one of five pairs is missing. With `apart`, as the query has it, a template
of few pairs whose share in another template reaches `containment` must also hold in full the pairs
that the other one lacks; templates that lie wholly in another are found in it as before.

Only SQL functions run. Templates are a small table (their bands are broadcast after a check of
their number). Whatever meets no band ends in the scan; only candidates are joined with texts.

Defined results: null or empty texts, and those of one word, have no license; templates of fewer than two
words have no pairs and are never found. Each input row has the licenses of its own text, whether its id is null or
repeated; repeated rows are repeated in the result. An empty table gives an empty result. A very long text is one array
of word hashes and its windows are made one after the other, so it takes some tens of bytes a word.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import materialize, only, small, text_key

WINDOW, STRIDE, BANDS, MET, CONTAINMENT = 8, 4, 16, 3, 0.8
#: Templates of fewer words are looked up by every pair.
BANDED = 5
#: Templates of so many pairs at most are told apart from similar ones.
FEW_PAIRS = 16

#: Fixed notices of well-known licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-redistribution": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation."
    ),
    "BSD-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "CC0-1.0": "This work is dedicated to the public domain under CC0 1.0.",
    "All-rights-reserved": "All rights reserved.",
}

_MASKS = [int(x) for x in np.random.default_rng(10).integers(-(2**63), 2**63 - 1, BANDS)]


def words(text: str) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}\p{N}]+"), 0)


def _window_arrays(hashes: Column, stride: int) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.size(hashes) - 1, F.lit(1)), F.lit(stride))
    return F.transform(starts, lambda i: F.struct(i.alias("at"), F.slice(hashes, i, WINDOW).alias("w")))


def _bands(windows: DataFrame, keep: list[str], single: bool = False) -> DataFrame:
    """(keep..., at, w) to (keep..., at, band, key); if `single`, also every pair of a window, as band `BANDS`."""
    pairs = windows.select(*keep, "at", *[F.when(F.get("w", F.lit(j + 1)).isNotNull(), F.xxhash64(F.get("w", F.lit(j)), F.get("w", F.lit(j + 1)))).alias(f"p{j}") for j in range(WINDOW - 1)])
    # bands are rows before they are hashed: all of them in one expression would be too long to compile
    masks = F.array(*map(F.lit, _MASKS + [0] * (WINDOW - 1 if single else 0)))
    got = pairs.where("p0 is not null").select("*", F.posexplode(masks).alias("band", "mask"))
    key = F.when(F.col("band") < BANDS, F.least(*[F.when(F.col(f"p{j}").isNotNull(), F.xxhash64(F.col(f"p{j}").bitwiseXOR(F.col("mask")))) for j in range(WINDOW - 1)]))
    for j in range(WINDOW - 1 if single else 0):
        key = key.when(F.col("band") == BANDS + j, F.col(f"p{j}"))
    return got.select(*keep, "at", F.least("band", F.lit(BANDS)).alias("band"), key.alias("key"))


def _pairs(tokens: Column) -> Column:
    return F.array_distinct(F.zip_with(F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))), F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b)))


def _pair_hashes(hashes: Column) -> Column:
    n = F.size(hashes) - 1
    return F.array_distinct(F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, 2, n), lambda a, b: F.xxhash64(a, b)))


def _telling(forms: DataFrame, containment: float) -> DataFrame:
    """(license, pairs) to (license, telling: the pairs that similar templates lack), for templates that have such."""
    pairs = forms.select("license", F.size("pairs").alias("n"), F.explode("pairs").alias("pair"))
    other = pairs.select(F.col("license").alias("other"), "pair")
    alike = pairs.where(F.col("n") <= FEW_PAIRS).join(other, "pair").where(F.col("license") != F.col("other")).groupBy("license", "other", "n")
    alike = alike.agg(F.collect_set("pair").alias("common")).where(F.size("common") / F.col("n") >= containment)
    lacks = alike.join(forms.select("license", "pairs"), "license").select("license", F.explode(F.array_except("pairs", "common")).alias("pair"))
    return lacks.groupBy("license").agg(F.collect_set("pair").alias("telling"))


def matches(documents: DataFrame, templates: DataFrame, id_col: str = "doc_id", text_col: str = "text", containment: float = CONTAINMENT, apart: bool = False) -> DataFrame:
    """`templates` (license, text) to distinct (id, tid: the text's key, license, containment: the best of its windows)."""
    forms = templates.select("license", words("text").alias("tokens")).where(F.size("tokens") > 1)
    forms = materialize(forms.select("license", "tokens", _pairs(F.col("tokens")).alias("pairs"), F.transform("tokens", lambda x: F.xxhash64(x)).alias("h")), "templates")
    shaped = _bands(forms.where(F.size("tokens") >= BANDED).select("license", F.inline(_window_arrays(F.col("h"), 1))), ["license"])
    shaped = shaped.select("license", "band", "key", F.lit(0).alias("bit"), F.lit(0).alias("n_pairs")).distinct()
    single = forms.where(F.size("tokens") < BANDED).select("license", F.size("pairs").alias("n_pairs"), F.posexplode(_pair_hashes(F.col("h"))).alias("i", "key"))
    single = single.select("license", F.lit(BANDS).alias("band"), "key", F.expr("shiftleft(1, i)").alias("bit"), "n_pairs")
    shaped = materialize(shaped.unionByName(single), "template_bands")
    kinds = {r["single"]: r["count"] for r in shaped.groupBy((F.col("band") == BANDS).alias("single")).count().collect()}  # two rows at most

    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null").withColumn("tid", text_key(F.col("text")))
    hashed = docs.select("id", "tid", F.transform(words("text"), lambda x: F.xxhash64(x)).alias("h"))
    met = _bands(hashed.select("id", "tid", F.inline(_window_arrays(F.col("h"), STRIDE))), ["id", "tid"], True in kinds)
    met = met.join(small(shaped), ["band", "key"])
    met = met.groupBy("id", "tid", "license", "at").agg(F.count("*").alias("bands"), F.bit_or("bit").alias("bits"), F.max("n_pairs").alias("n_pairs"))
    met = met.where((F.col("bands") >= MET) | (F.col("bits") > 0)).groupBy("id", "tid", "license")
    met = met.agg(F.collect_set("at").alias("places"), F.bit_or("bits").alias("bits"), F.max("n_pairs").alias("n_pairs"))
    met = met.where(F.bit_count("bits") / F.greatest("n_pairs", F.lit(1)) >= F.when(F.col("n_pairs") > 0, containment).otherwise(0.0))
    near = materialize(met.select("id", "tid", "license", "places"), "license_candidates")

    # texts travel as they are, once for all their candidates, and are cut into words after the join
    texts = only(docs, near.select("id", "tid").distinct(), "id", "text").select(F.col("id").alias("text_id"), F.col("tid").alias("text_tid"), "text")
    hits = near.groupBy("id", "tid").agg(F.collect_list(F.struct("license", "places")).alias("hits"))
    cut = hits.join(texts, F.col("id").eqNullSafe(F.col("text_id")) & (F.col("tid") == F.col("text_tid"))).select("id", "tid", "hits", words("text").alias("words"))
    shapes = forms.select("license", "pairs", F.size("tokens").alias("n"))
    if apart:
        shapes = materialize(shapes.join(_telling(forms, containment), "license", "left"), "template_pairs")
    else:
        shapes = shapes.withColumn("telling", F.lit(None).cast("array<string>"))
    both = cut.select("id", "tid", "words", F.inline("hits")).join(small(shapes), "license")
    local = F.transform("places", lambda at: _pairs(F.slice("words", F.greatest(F.lit(1), at - F.col("n")), F.lit(WINDOW) + 2 * F.col("n"))))
    if apart:
        local = F.filter(local, lambda x: F.col("telling").isNull() | (F.size(F.array_except("telling", x)) == 0))
    around = F.transform(local, lambda x: F.size(F.array_intersect(F.col("pairs"), x)) / F.size("pairs"))
    found = both.select("id", "tid", "license", F.array_max(around).alias("containment")).where(F.col("containment") >= containment)
    return found.groupBy("id", "tid", "license").agg(F.max("containment").alias("containment")).withColumnRenamed("id", id_col)


def template_table(spark) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES.items()), "license string, text string")


def scan(documents: DataFrame, templates: DataFrame, id_col: str = "doc_id", text_col: str = "text", containment: float = CONTAINMENT, apart: bool = False) -> DataFrame:
    """One row per document row: id, n_licenses, licenses (sorted, comma-joined), containment (the best; 0 if none)."""
    found = matches(documents, templates, id_col, text_col, containment, apart).groupBy(id_col, "tid").agg(F.array_sort(F.collect_set("license")).alias("l"), F.max("containment").alias("c"))
    found = found.toDF("found_id", "found_tid", "l", "c")
    own = documents.select(F.col(id_col), text_key(F.col(text_col)).alias("own_tid"))
    got = own.join(found, own[id_col].eqNullSafe(found["found_id"]) & (own["own_tid"] == found["found_tid"]), "left")
    return got.select(id_col, F.coalesce(F.size("l"), F.lit(0)).cast("long").alias("n_licenses"), F.coalesce(F.concat_ws(",", "l"), F.lit("")).alias("licenses"), F.coalesce("c", F.lit(0.0)).alias("containment"))

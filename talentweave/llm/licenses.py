"""Licence notices in documents, with DataFrame functions only.

Words are runs of letters, digits, dots and dashes without their closing punctuation, in lower case; a shingle is five words. Templates
fall into classes of shingle counts that double; each class reads a text in windows of twice the class size that overlap by half, so
some window holds any occurrence as a whole. A window and a template it holds to four fifths have a Jaccard similarity of 0.3 at
least; 16 bands of one minimum each then miss them with probability 0.7^16, that is 0.3 %, and two windows usually hold an
occurrence. Candidates count when the window holds 0.8 of the template's shingles.

Texts that share no shingle with any template can't hold one and are left out before windows are made.

Null and empty texts and texts of fewer than five words hold no notice. Repeated rows of a doc_id give one row a template. Empty
tables give an empty result. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talentweave.llm.common import table

SHINGLE, LEAST = 5, 0.8
BANDS = 16

#: Notices to look for, by a name of the licence.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
    ),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 notice": (
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on "
        "an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation"
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met"
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}


def word_list(text: Column) -> Column:
    """Words of a text; dots and dashes stay inside words only."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}.-]+|[.-]+(?![\p{L}\p{N}])"), lambda w: w != "")


def with_shingles(df: DataFrame) -> DataFrame:
    """``shingles`` in place of ``text``: hashes of each run of five words, in order.

    A column that an explode makes is computed once; a filter on it isn't pushed below, where it would repeat the work a word.
    """
    rest = [c for c in df.columns if c != "text"]
    df = df.select(*rest, F.explode(F.array(word_list(F.coalesce(F.col("text"), F.lit(""))))).alias("words"))
    n = F.size("words") - (SHINGLE - 1)
    runs = F.transform(
        F.slice("words", 1, F.greatest(n, F.lit(0))),
        lambda w, i: F.xxhash64(w, *[F.get("words", i + k) for k in range(1, SHINGLE)]),
    )
    return df.select(*rest, F.explode(F.array(runs)).alias("shingles"))


def smallest(window: Column, seed: int) -> Column:
    return F.array_min(F.transform(window, lambda x: F.xxhash64(x, F.lit(seed))))


def minima(window: Column) -> Column:
    """One band for each seed: the seed's number and the smallest seeded hash of the window."""
    return F.array(*[F.xxhash64(F.lit(k), smallest(window, k)) for k in range(BANDS)])


def templates_of(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """``template``, ``shingles``, ``class`` (upper shingle count) and ``bands``."""
    rows = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(k).alias("template"), F.lit(v).alias("text")) for k, v in templates.items()])).alias("r"))
    rows = with_shingles(rows.select("r.template", "r.text")).where(F.size("shingles") > 0)
    size = F.pow(F.lit(2), F.ceil(F.log2(F.size("shingles").cast("double")))).cast("int")
    rows = rows.select("template", F.array_distinct("shingles").alias("shingles"), size.alias("class"))
    return rows.select("template", "shingles", "class", F.explode(F.array(minima(F.col("shingles")))).alias("bands"))


def find_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """``doc_id``, ``template``, ``containment`` and ``first_word`` of the best window. ``templates`` is a short list held by every task."""
    spark = docs.sparkSession
    known = templates_of(spark, templates or TEMPLATES)
    facts = known.select("class", "shingles").collect()  # as many rows as templates
    every = sorted({h for r in facts for h in r["shingles"]})
    classes = sorted({r["class"] for r in facts})
    texts = with_shingles(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).select("doc_id", "shingles")
    texts = texts.where(F.exists("shingles", lambda h: h.isin(every)))
    size = F.explode(F.array(*[F.lit(c) for c in classes])).alias("class")
    windows = texts.select("doc_id", "shingles", size)
    begin = F.sequence(F.lit(1), F.greatest(F.size("shingles"), F.lit(1)), F.col("class"))
    windows = windows.select("doc_id", "class", "shingles", F.explode(begin).alias("begin")).select(
        "doc_id", "class", "begin", F.explode(F.array(F.slice("shingles", F.col("begin"), 2 * F.col("class")))).alias("window"))
    # A window without any shingle of a template shares no minimum with one.
    windows = windows.where(F.exists("window", lambda h: h.isin(every)))
    bands = windows.withColumn("band", F.explode(minima(F.col("window"))))
    wanted = known.select("template", F.col("class").alias("_class"), F.col("shingles").alias("_shingles"), F.explode("bands").alias("_band"))
    hits = bands.join(F.broadcast(wanted), (F.col("band") == F.col("_band")) & (F.col("class") == F.col("_class")))  # a short list
    share = F.size(F.array_intersect("_shingles", "window")) / F.size("_shingles")
    first = F.array_min(F.transform(F.array_intersect("_shingles", "window"), lambda h: F.array_position("window", h))) + F.col("begin") - 2
    found = hits.select("doc_id", "template", share.alias("containment"), first.cast("long").alias("first_word")).where(F.col("containment") >= LEAST)
    best = found.groupBy("doc_id", "template").agg(F.max(F.struct("containment", (-F.col("first_word")).alias("back"))).alias("best"))
    return best.select("doc_id", "template", "best.containment", (-F.col("best.back")).alias("first_word"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_licenses(table(spark, sf_dir, "documents"))

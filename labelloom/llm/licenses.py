"""License scans: MinHash bands over text windows retrieve templates, containment verifies.

Words are lower-cased and freed of punctuation; five in a row are a shingle. Of a text only
shingles that some template has are looked at any further, which leaves nothing of most
texts. Templates fall into classes by size: up to 1, 2, 4, 8, ... shingles. For each class,
windows of twice its size overlap by half, so a template always lies inside one, and what
it shares with the window is a fifth of the two at least: of 2c places in the window, c
over two or more belong to the template, and four fifths of these must be there. Windows
and templates have 64 bands of one MinHash value each; a template with an equal value in
some band is retrieved. One that shares a fifth is missed with probability 0.8**64, less
than one in a million. Retrieved templates are verified exactly: the window must contain at
least 80 % of the template's shingles.

Defined cases: null and empty texts match nothing; rows that repeat an id are scanned one by
one and give a match per row; rows without an id give matches without one; a template must
have as many words as a shingle: five, or three in the scan of short notices. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.llm.license_texts import SHORT, TEXTS
from labelloom.plans.registry import query

SHINGLE = 5
# Shingles of notices that have fewer words than that.
SHORT_SHINGLE = 3
BANDS = 64
CONTAINED = 0.8
MARKS = ".,;:()[]{}<>\"'!?/*#\t\n\r\x0b\x0c"
# Public license notices.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "either version 3 of the License, or (at your option) any later version"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    *TEXTS,
]


def _words(text: Column) -> Column:
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), MARKS, " " * len(MARKS))
    return F.transform(F.array_remove(F.split(plain, " "), ""), lambda w: F.xxhash64(w))


def _with_shingles(df: DataFrame, text: str, name: str, shingle: int) -> DataFrame:
    """Add the hashes of all shingles, in text order; an array of its own per stage."""
    g = F.col("_w")
    hashes = F.transform(g, lambda x, i: F.xxhash64(x, *[F.get(g, i + k) for k in range(1, shingle)]))
    return df.withColumn("_w", _words(F.col(text))).withColumn(
        name, F.when(F.size(g) >= shingle, F.slice(hashes, 1, F.size(g) - (shingle - 1)))
    ).drop("_w")


def _bands(shingles: str) -> Column:
    """Band number and MinHash value of a set of shingles."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda b: F.struct(b.alias("b"), F.array_min(F.transform(F.col(shingles), lambda h: F.xxhash64(h, b))).alias("v")),
    )


def template_table(spark: SparkSession, templates: list[tuple[str, str]], shingle: int = SHINGLE) -> DataFrame:
    """``(license, notice, shingles, c)``: as many rows as templates; ``c`` is the size class."""
    rows = spark.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("license"), F.lit(i).alias("notice"), F.lit(t).alias("text"))
        for i, (n, t) in enumerate(templates)
    ])).alias("t")).select("t.*")
    size = F.pow(F.lit(2), F.ceil(F.log2(F.size("shingles")))).cast("int")
    return _with_shingles(rows, "text", "_s", shingle).select(
        "license", "notice", F.array_distinct("_s").alias("shingles")
    ).withColumn("c", size)


def scan(
    docs: DataFrame, key: str = "doc_id", text: str = "text", templates: list[tuple[str, str]] | None = None, shingle: int = SHINGLE
) -> DataFrame:
    """``(key, license, notice, containment, word)``: best window per row and template.

    ``word`` is the number of the window's first template word.
    """
    spark = docs.sparkSession
    table = template_table(spark, templates or TEMPLATES, shingle)
    # Some two thousand hashes, as many as the given templates have shingles.
    known = table.collect()
    if any(not r["shingles"] for r in known):
        raise ValueError(f"a template must have {shingle} words")
    classes: dict[int, set[int]] = {}
    for r in known:
        classes.setdefault(r["c"], set()).update(r["shingles"])
    universe = sorted(set().union(*classes.values()))
    places = F.transform("_s", lambda h, i: F.struct(i.alias("i"), h.alias("h")))
    hit = _with_shingles(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "text", "_s", shingle).select(
        "key", F.filter(places, lambda e: e["h"].isin(universe)).alias("e"),
        # Beside the row's number the filter stays above the arrays that it looks at.
        F.monotonically_increasing_id().alias("row"),
    ).filter(F.size("e") > 0)

    def one_class(size: int):
        some = sorted(classes[size])
        return F.struct(F.lit(size).alias("c"), F.filter("e", lambda x: x["h"].isin(some)).alias("e"))

    by_class = F.array(*map(one_class, sorted(classes)))
    c, n = F.col("c"), F.col("n")
    numbers = F.array_distinct(F.flatten(F.transform(
        "e", lambda x: F.array(F.floor(x["i"] / c), F.greatest(F.floor(x["i"] / c) - 1, F.lit(0)))
    )))
    windows = (
        hit.select("row", "key", F.explode(by_class).alias("x")).select("row", "key", "x.c", "x.e")
        .select("row", "key", "c", "e", F.explode(numbers).alias("n"))
        .withColumn("e", F.filter("e", lambda x: (x["i"] >= n * c) & (x["i"] < (n + 2) * c)))
        .select("row", "key", "c", "n", F.array_distinct(F.col("e.h")).alias("own"), F.element_at("e", 1)["i"].alias("word"))
    )
    banded = table.select("license", "notice", "c", "shingles", F.explode(_bands("shingles")).alias("x"))
    retrieved = (
        windows.select("*", F.explode(_bands("own")).alias("x"))
        .select("row", "key", "c", "n", "own", "word", "x.b", "x.v")
        # Templates times bands, whatever the size of the data.
        .join(F.broadcast(banded.select("license", "notice", "c", "shingles", "x.b", "x.v")), ["c", "b", "v"])
    )
    share = F.size(F.array_intersect("own", "shingles")) / F.size("shingles")
    return (
        retrieved.withColumn("containment", F.round(share, 6)).filter(F.col("containment") >= CONTAINED)
        .groupBy("row", "key", "license", "notice")
        .agg(F.max("containment").alias("containment"), F.min("word").alias("word"))
        .select("key", "license", "notice", "containment", F.col("word").cast("long").alias("word"))
    )


def _sql(templates: list[tuple[str, str]] = TEMPLATES, shingle: int = SHINGLE) -> str:
    marks = "".join("\\" + c if c in "[]" else c.replace("'", "''") for c in MARKS if c >= " ") + r"\t\n\r\x0b\x0c"
    words = lambda t: f"list_filter(string_split(regexp_replace(lower(coalesce({t}, '')), '[{marks}]', ' ', 'g'), ' '), lambda w: w <> '')"
    rows = ", ".join(f"({i}, '{n}', '{t}')" for i, (n, t) in enumerate(templates))
    return rf"""
WITH tw AS (SELECT notice, license, {words('t')} AS w FROM (VALUES {rows}) AS v(notice, license, t)),
ts AS (SELECT DISTINCT notice, license, w[i:i + {shingle - 1}] AS g FROM tw, unnest(generate_series(1, len(w) - {shingle - 1})) AS u(i)),
size AS (SELECT notice, count(*) AS total FROM ts GROUP BY notice),
class AS (SELECT DISTINCT g, pow(2, ceil(log2(total)))::BIGINT AS c FROM ts JOIN size USING (notice)),
dw AS (SELECT doc_id, {words('text')} AS w FROM documents),
ds AS (SELECT doc_id, i - 1 AS i, w[i:i + {shingle - 1}] AS g FROM dw, unnest(generate_series(1, len(w) - {shingle - 1})) AS u(i)),
hit AS (SELECT doc_id, i, g, c FROM ds JOIN class USING (g)),
win AS (SELECT DISTINCT doc_id, i, g, c, n FROM (SELECT *, unnest([i // c, greatest(i // c - 1, 0)]) AS n FROM hit)),
inside AS (SELECT * FROM win WHERE i >= n * c AND i < (n + 2) * c),
first AS (SELECT doc_id, c, n, min(i) AS word FROM inside GROUP BY ALL),
share AS (
  SELECT doc_id, c, n, license, notice, round(count(DISTINCT inside.g)::DOUBLE / any_value(total), 6) AS containment
  FROM inside JOIN ts USING (g) JOIN size USING (notice) WHERE c = pow(2, ceil(log2(total)))::BIGINT GROUP BY ALL)
SELECT doc_id, license, notice::INTEGER AS notice, max(containment) AS containment, min(word)::BIGINT AS word
FROM share JOIN first USING (doc_id, c, n) WHERE containment >= {CONTAINED} GROUP BY doc_id, license, notice
"""


@query("op8_license_scan", _sql())
def op8(spark, sf):
    """License notices in all documents."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return scan(docs).withColumnRenamed("key", "doc_id")


@query("op8_short_notices", _sql(SHORT, SHORT_SHINGLE))
def op8_short(spark, sf):
    """License notices of under five words in all documents."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return scan(docs, templates=SHORT, shingle=SHORT_SHINGLE).withColumnRenamed("key", "doc_id")

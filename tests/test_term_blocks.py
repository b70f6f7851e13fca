"""Operators that look terms up block by block: a term is asked for once a block, in any form of counts."""

import math
from collections import Counter

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from labelloom.llm import simhash
from labelloom.operators import bayes, blocks, training, vectors, vocabulary, weights

ROWS = [(1, "x", 0, "a b a"), (2, "y", 1, "b c"), (3, "x", 1, "a a c"), (3, "x", 1, "d"), (4, "y", 0, "")]


@pytest.fixture
def asked(monkeypatch):
    rows = []

    def counted(facts, *args, **kwargs):
        rows.append(facts.count())
        return real(facts, *args, **kwargs)

    real = blocks.lookup
    monkeypatch.setattr(blocks, "lookup", counted)
    return rows


def docs(spark, rows=ROWS, copies=1):
    df = spark.createDataFrame(rows, "d long, l string, f int, text string").coalesce(1)
    tokens = F.filter(F.split("text", " "), lambda w: w != "")
    many = df.join(spark.range(copies).select((F.col("id") * 10).alias("k"))).withColumn("d", F.col("d") + F.col("k"))
    return many.select("d", "l", "f", tokens.alias("t")).coalesce(1)


def forms(spark, *keep):
    rows = docs(spark)
    yield vocabulary.document_terms(rows, "t", *keep)
    yield vocabulary.term_counts(rows, "t", *keep)


def test_known_terms_of_both_forms(spark):
    known = spark.createDataFrame([("a", 2), ("d", 1)], "term string, df long")
    for counts in forms(spark, "d", "l"):
        got = vocabulary.restrict(counts, known)
        assert got.columns == ["d", "l", "term", "tf"]
        assert sorted(map(tuple, got.collect())) == [(1, "x", "a", 2), (3, "x", "a", 2), (3, "x", "d", 1)]


def test_idf_of_both_forms(spark):
    for counts in forms(spark, "d"):
        got = Counter((r["d"], r["term"], round(r["weight"], 9)) for r in weights.spark_idf(counts, "d", F.lit(5), 2).collect())
        w = lambda tf: round(tf * math.log(6 / 3), 9)
        assert got == Counter({
            (1, "a", w(2)): 1, (1, "b", w(1)): 1, (2, "b", w(1)): 1, (2, "c", w(1)): 1,
            (3, "a", w(2)): 1, (3, "c", w(1)): 1, (3, "d", 0.0): 1,
        })


def test_summary_of_word_ids(spark):
    words = spark.createDataFrame([("a", 4, 1), ("b", 2, 2), ("d", 1, 7)], "word string, uses long, word_id int")
    rows = vocabulary.document_terms(docs(spark), "t", "d")
    got = {tuple(r) for r in vocabulary.id_summary(rows, "d", words).collect()}
    assert got == {(1, 3, 4, 1, 2), (2, 1, 2, 2, 2), (3, 3, 9, 1, 7)}


def test_scores_of_both_forms_and_repeated_keys(spark):
    rows = docs(spark)
    classes, terms = bayes.fit(rows, vocabulary.term_counts(rows, "t", "l"), "l")
    theta = {(r["l"], r["term"]): r["theta"] for r in bayes.theta(classes, terms, "l").collect()}
    pi = {r["l"]: r["pi"] for r in classes.collect()}
    bag = {}
    for d, _, _, text in ROWS:
        bag.setdefault(d, []).extend(text.split())
    for counts in forms(spark, "d"):
        got = bayes.score(rows, counts, "d", classes, terms, "l").collect()
        assert sorted(r["d"] for r in got) == [1, 2, 3, 3, 4]
        for r in got:
            want = {c: pi[c] + sum(theta[c, w] for w in bag[r["d"]]) for c in "xy"}
            assert {s["label"]: s["score"] for s in r["scores"]} == pytest.approx(want)


def test_vectors_of_tokens(spark):
    ids = spark.createDataFrame([(1, [2, 0, 1, 2]), (2, []), (3, [9])], "d long, ids array<int>")
    table = spark.createDataFrame([(1, 1, [1.0]), (2, 2, [2.0]), (2, 2, [3.0])], "word_id int, uses long, vector array<double>")
    got = sorted((r["d"], r["pos"], r["word_id"], r["vector"] or []) for r in vectors.token_vectors(ids, "d", table, "uses").collect())
    assert got == [
        (1, 0, 2, [2.0]), (1, 0, 2, [3.0]), (1, 1, 0, []), (1, 2, 1, [1.0]), (1, 3, 2, [2.0]), (1, 3, 2, [3.0]), (3, 0, 9, []),
    ]


def test_a_term_is_asked_for_once_a_block(spark, asked):
    rows = docs(spark, copies=100)
    terms = vocabulary.document_terms(rows, "t", "d", "l", "f")
    known = spark.createDataFrame([(w, 100, i) for i, w in enumerate("abcd", 1)], "word string, uses long, word_id int")
    fitted = known.select(F.col("word").alias("term"), F.col("uses").alias("df"))
    classes, likely = bayes.fit(rows, vocabulary.term_counts(rows, "t", "l"), "l")
    few = terms.select("d", "terms")
    vocabulary.restrict(few, fitted)
    weights.spark_idf(few, "d", F.lit(500))
    vocabulary.id_summary(few, "d", known)
    bayes.score(rows, few, "d", classes, likely, "l")
    bayes.cross_validate(terms, "d", "l", "f", 2, [1.0])
    ids = vocabulary.encode_known(rows, "d", "t", known).coalesce(1)
    vectors.token_vectors(ids, "d", known.select("word_id", "uses", F.array(F.lit(1.0)).alias("vector")), "uses")
    assert asked == [4] * 7


def test_texts_are_laid_out_alike_at_every_size(spark):
    texts = spark.createDataFrame([(i, f"some text {i % 3}") for i in range(9)], "doc_id long, text string")
    plan = simhash.deduplicate(texts)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "BroadcastHashJoin" not in plan


def test_partitions_of_wide_fits_follow_cores_and_entries(spark, monkeypatch):
    rows = spark.createDataFrame([(0.0, Vectors.sparse(9, {1: 1.0, 2: 1.0}))] * 50, ["label", "features"])
    assert training.wide_partitions(rows) == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(training, "PARTITION_ENTRIES", 5)
    assert training.wide_partitions(rows) == 20

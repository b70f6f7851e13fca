"""Block lookups against plain Python, and how little they ask for."""

import math
from collections import Counter

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from labelloom import storage
from labelloom.operators import bayes, blocks, vectors, vocabulary, weights
from labelloom.plans import features, model_reports, registered

TEXTS = [(1, "a b a c"), (2, "b zz b"), (3, ""), (4, None), (None, "c a"), (5, "zz"), (6, "a b"), (6, "b c")]


@pytest.fixture
def asked(monkeypatch):
    """Rows of all lookups."""
    rows = []

    def counted(facts, *args, **kwargs):
        rows.append(facts.count())
        return real(facts, *args, **kwargs)

    real = blocks.lookup
    monkeypatch.setattr(blocks, "lookup", counted)
    return rows


def docs(spark):
    return spark.createDataFrame(TEXTS, "d long, text string").select("d", F.split("text", " ").alias("t")).coalesce(1)


def test_ids_of_known_words(spark):
    words = spark.createDataFrame([("a", 9, 1), ("b", 9, 2), ("c", 9, 3)], "word string, uses long, word_id long")
    got = {r["d"]: r["ids"] for r in vocabulary.encode_known(docs(spark), "d", "t", words).collect()}
    # Rows that share a key are one, by position.
    assert got == {1: [1, 2, 1, 3], 2: [2, 2], 3: [], 4: [], None: [3, 1], 5: [], 6: [1, 2, 2, 3]}


@pytest.mark.parametrize("size", [1, 3, 100])
def test_blocks_hold_all_rows(spark, size):
    rows = blocks.row_blocks(docs(spark), ["d"], "t", size=size).collect()
    back = []
    for r in rows:
        at = 0
        for row, n in zip(r["rows"], r["sizes"], strict=True):
            back.append((row["d"], " ".join(r["words"][i] for i in r["ids"][at : at + n])))
            at += n
        assert len(r["rows"]) == 1 or at <= size
        assert Counter(r["ids"]) == dict(enumerate(r["uses"]))
    assert sorted(map(str, back)) == sorted(str((d, t or "")) for d, t in TEXTS)


def test_a_word_is_asked_for_once_a_block(spark, asked):
    many = spark.range(500).select(F.col("id").alias("d"), F.split(F.lit("a b c a b"), " ").alias("t")).coalesce(1)
    words = spark.createDataFrame([("a", 9, 1), ("b", 9, 2), ("c", 9, 3)], "word string, uses long, word_id long")
    encoded = vocabulary.encode_known(many, "d", "t", words)
    table = words.select("word_id", F.array(F.lit(0.5), F.lit(-1.0)).alias("vector"), (F.col("word_id") > 1).alias("known"))
    sums = vectors.pooled_sums(encoded.coalesce(1), "d", table).collect()
    terms = vocabulary.document_terms(many, "t", "d")
    scored = weights.tfidf(terms.coalesce(1), "d", F.lit(500)).collect()
    assert len(sums) == len(scored) == 500
    assert {(r["n"], r["n_known"], *r["sums"], *r["known_sums"]) for r in sums} == {(5, 3, 2.5, -5.0, 1.5, -3.0)}
    # Three words in each of a few blocks, instead of 2,500, 2,500 and 1,500 entries.
    assert len(asked) == 3 and sum(asked) < 200


def test_weights_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks.row_blocks, "__defaults__", (None, 2))
    terms = vocabulary.document_terms(docs(spark).filter("d < 6"), "t", "d")
    got = {r["d"]: {e["term"]: e["weight"] for e in r["terms"]} for r in weights.tfidf(terms, "d", F.lit(5), min_df=2).collect()}
    idf = {w: math.log(6 / 3) + 1 for w in ("b", "zz")}
    assert set(got) == {1, 2, 3, 4, 5} and got[3] == got[4] == {}
    norm = math.hypot(2 * idf["b"], idf["zz"])
    want = {1: {"b": 1.0}, 2: {"b": 2 * idf["b"] / norm, "zz": idf["zz"] / norm}, 5: {"zz": 1.0}}
    for d, entries in want.items():
        assert got[d] == pytest.approx(entries)


def test_vectors_listed_twice_count_twice(spark):
    encoded = spark.createDataFrame([(1, [1, 2, 1]), (2, [2]), (3, [])], "d long, ids array<int>")
    table = spark.createDataFrame(
        [(1, [1.0], True), (1, [3.0], True), (2, [5.0], False)], "word_id long, vector array<float>, known boolean"
    )
    got = {r["d"]: tuple(r)[1:] for r in vectors.pooled_sums(encoded, "d", table).collect()}
    assert got == {1: (5, 4, [13.0], [8.0]), 2: (1, 0, [5.0], [0.0]), 3: (0, 0, None, None)}


def test_a_block_is_a_row_group_of_its_own(spark):
    made = blocks.row_blocks(docs(spark), ["d"], "t", size=1)
    files = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in made.inputFiles()]
    assert sum(m.num_rows for m in files) == sum(m.num_row_groups for m in files) > 3
    assert {f.name for f in made.schema.fields if isinstance(f.dataType, BinaryType)} == {"data"}


@pytest.fixture
def fixed_plans(spark):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", before)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_rows_that_share_no_key_are_laid_out_once(spark, fixed_plans, monkeypatch):
    words = spark.createDataFrame([("a", 9, 1), ("b", 9, 2)], "word string, uses long, word_id long")
    table = words.select("word_id", F.array(F.lit(0.5)).alias("vector"))
    merged, real = [], blocks.row_blocks

    def seen(df, *args, **kwargs):
        merged.append("collect_list" in df._jdf.queryExecution().executedPlan().toString())
        return real(df, *args, **kwargs)

    for module in (weights, vectors):
        monkeypatch.setattr(module, "row_blocks", seen)
    for rows, twice in ((docs(spark).filter("d in (2, 3, 4)"), False), (docs(spark).filter("d >= 5"), True)):
        encoded = vocabulary.encode_known(rows, "d", "t", words)
        assert exchanges(encoded) == 1 + twice
        ids = spark.createDataFrame([(r["d"], r["n"]) for r in rows.selectExpr("d", "array(1, 2) n").collect()], "d long, ids array<int>")
        assert weights.tfidf(vocabulary.document_terms(rows, "t", "d"), "d", F.lit(3)).count() == rows.select("d").distinct().count()
        assert {r["n"] for r in vectors.pooled_sums(ids, "d", table).collect()} == ({2, 4} if twice else {2})
    assert merged == [False, False, True, True]


def test_grams_are_not_written_before_they_are_weighted(spark, tmp_path, monkeypatch):
    spark.createDataFrame(
        [(i, "some words and more words of it", "en", "web") for i in range(6)], "doc_id long, text string, lang string, source string"
    ).write.parquet(str(tmp_path / "documents.parquet"))
    names = []
    real = storage.written
    for module in (features, model_reports, weights, blocks, bayes):
        monkeypatch.setattr(module, "written", lambda df, name, **options: names.append(name) or real(df, name, **options))
    for query in ("agg_chi2_terms", "vec_tfidf_sublinear", "top_chi2_per_class", "top_coef_bayes"):
        assert registered()[query](spark, str(tmp_path)).count() > 0
    assert not {"document-terms", "gram-weights"} & set(names) and names.count("blocks") == 4

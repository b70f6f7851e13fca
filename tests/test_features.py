import math
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import IDF, CountVectorizerModel
from pyspark.sql import functions as F

from labelloom.functions import arrays as A
from labelloom.operators import bayes, labels, lookup, vectors, vocabulary, weights
from labelloom.operators.statistics import scalar_count

TEXTS = ["b a a c", "", "c c c b", "d", "a b"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(
        [(i, "x" if i < 3 else "y", x.split()) for i, x in enumerate(TEXTS)],
        "doc_id long, label string, tokens array<string>",
    ).cache()


def test_term_counts(docs):
    rows = vocabulary.term_counts(docs, "tokens", "doc_id").collect()
    got = {(r["doc_id"], r["term"]): r["tf"] for r in rows}
    want = {(i, w): n for i, x in enumerate(TEXTS) for w, n in Counter(x.split()).items()}
    assert got == want


def test_top_words_break_ties_by_first_appearance(docs):
    rows = vocabulary.top_words(docs, "doc_id", "tokens", 4).orderBy("word_id").collect()
    # c 4, b 3, a 3 (b is seen first), d 1 is cut.
    assert [(r["word"], r["uses"], r["word_id"]) for r in rows] == [("c", 4, 1), ("b", 3, 2), ("a", 3, 3)]


def test_frequent_terms_respect_both_limits(docs):
    counts = vocabulary.term_counts(docs, "tokens", "doc_id")
    rows = vocabulary.frequent_terms(counts, size=2, min_df=2).orderBy("term_id").collect()
    assert [(r["term"], r["df"], r["uses"]) for r in rows] == [("c", 2, 4), ("a", 2, 3)]


def test_tfidf_against_brute_force(docs):
    rows = vocabulary.document_terms(docs, "tokens", "doc_id")
    scored = weights.tfidf(rows, "doc_id", scalar_count(docs), 2, sublinear=True).collect()
    assert len(scored) == len(TEXTS)  # documents without a known term as well
    got = {(r["doc_id"], e["term"]): e["weight"] for r in scored for e in r["terms"]}
    n, df = len(TEXTS), Counter(w for x in TEXTS for w in set(x.split()))
    want = {}
    for i, x in enumerate(TEXTS):
        raw = {
            w: (1 + math.log(tf)) * (math.log((1 + n) / (1 + df[w])) + 1)
            for w, tf in Counter(x.split()).items() if df[w] >= 2
        }
        norm = math.sqrt(sum(v * v for v in raw.values()))
        want |= {(i, w): v / norm for w, v in raw.items()}
    assert got == pytest.approx(want)


def test_spark_idf_equals_ml_idf(spark, docs):
    terms = ["a", "b", "c", "d"]
    counted = CountVectorizerModel.from_vocabulary(terms, inputCol="tokens", outputCol="tf").transform(docs)
    ml = IDF(inputCol="tf", outputCol="w", minDocFreq=2).fit(counted).transform(counted)
    want = {
        (r["doc_id"], terms[i]): v
        for r in ml.collect() for i, v in zip(r["w"].indices, r["w"].values, strict=True)
    }
    counts = vocabulary.term_counts(docs, "tokens", "doc_id")
    rows = weights.spark_idf(counts, "doc_id", scalar_count(docs), 2).collect()
    assert {(r["doc_id"], r["term"]): r["weight"] for r in rows} == pytest.approx(want)


def test_chi_square_against_brute_force(docs):
    counts = vocabulary.term_counts(docs, "tokens", "doc_id", "label")
    w = counts.withColumn("weight", F.col("tf").cast("double")).drop("tf")
    rows = weights.chi_square(w, "label", weights.class_shares(docs, "label")).collect()
    got = {(r["label"], r["term"]): r["chi2"] for r in rows}
    assert len(got) == 8  # also terms that never occur in a class
    for (label, term), value in got.items():
        o = sum(x.split().count(term) for i, x in enumerate(TEXTS) if ("x" if i < 3 else "y") == label)
        f = sum(x.split().count(term) for x in TEXTS)
        p = (3 if label == "x" else 2) / 5
        want = (o - p * f) ** 2 / (p * f) + (f - o - (1 - p) * f) ** 2 / ((1 - p) * f)
        assert value == pytest.approx(want)


@pytest.mark.parametrize("n", [0, 1, 160, 161])
def test_fixed_length_encoding(spark, n):
    df = spark.createDataFrame([(1, [f"w{i}" for i in range(n)]), (2, ["w0"])], "doc_id long, tokens array<string>")
    words = vocabulary.distinct_words(df, "tokens")
    assert words.agg(F.min("word_id")).first()[0] == 1  # 0 is padding
    ids = {r["word"]: r["word_id"] for r in words.collect()}
    out = {r["doc_id"]: r["ids"] for r in vocabulary.encode_fixed(df, "doc_id", "tokens", words).collect()}
    want = [ids[f"w{i}"] for i in range(min(n, 160))]
    assert out[1] == want + [0] * (160 - len(want))
    assert out[2] == [ids["w0"]] + [0] * 159


def test_ids_are_dense_and_reproducible(spark, docs):
    one = vocabulary.distinct_words(docs, "tokens")
    two = vocabulary.distinct_words(docs.repartition(5), "tokens")
    assert one.exceptAll(two).count() == 0
    assert sorted(r["word_id"] for r in one.collect()) == [1, 2, 3, 4]


def test_known_words_and_left_padding(spark, docs):
    vocab = spark.createDataFrame([("a", 3, 1), ("c", 4, 2)], "word string, uses long, word_id int")
    out = vocabulary.pad_to_longest(vocabulary.encode_known(docs, "doc_id", "tokens", vocab))
    assert {r["doc_id"]: r["ids"] for r in out.collect()} == {
        0: [1, 1, 2], 1: [0, 0, 0], 2: [2, 2, 2], 3: [0, 0, 0], 4: [0, 0, 1],
    }


def test_chunks_and_one_hot(spark):
    df = spark.createDataFrame([(list(range(160)),)], "ids array<int>")
    chunks = df.select(A.chunk(F.col("ids"), 16, 10).alias("c")).first()["c"]
    assert [x for c in chunks for x in c] == list(range(160)) and len(chunks) == 16
    rows = spark.createDataFrame([("b",), ("a",)], "l string")
    hot = labels.with_one_hot(rows, "l", "h").collect()
    assert {r["l"]: r["h"] for r in hot} == {"a": [1, 0], "b": [0, 1]}


@pytest.mark.parametrize("scores, best", [([0.5, 0.5, 0.1], 0), ([1.0, 1.0], 0), ([3.0], 0), ([0.0, 2.0], 1)])
def test_argmax_takes_the_first(spark, scores, best):
    df = spark.createDataFrame([(scores,)], "s array<double>")
    assert df.select(A.argmax(F.col("s"))).first()[0] == best


def test_cross_entropy_is_stable_and_agrees_with_one_hot(spark):
    df = spark.createDataFrame([([1000.0, 0.0, -5.0], 1, [0, 1, 0])], "s array<double>, l int, t array<int>")
    a, b = df.select(A.cross_entropy(F.col("s"), F.col("l")), A.cross_entropy_one_hot(F.col("s"), F.col("t"))).first()
    assert a == pytest.approx(1000.0) and b == pytest.approx(1000.0)


def test_min_max_uses_one_range_and_gives_null_without_one(spark):
    df = spark.createDataFrame([([-2.0, 0.0],), ([2.0, 1.0],)], "x array<double>")
    got = [r["y"] for r in weights.min_max(df, "x", "y").collect()]
    assert sorted(got) == [[0.0, 0.5], [1.0, 0.75]]
    flat = spark.createDataFrame([([3.0, 3.0],)], "x array<double>")
    assert weights.min_max(flat, "x", "y").first()["y"] == [None, None]


def test_mean_of_arrays_is_a_true_mean(spark):
    df = spark.createDataFrame([("w", [1.0, 2.0]), ("w", [3.0, 4.0]), ("w", [8.0, 9.0])], "k string, v array<double>")
    assert vectors.mean_by_key(df, "k", "v").first()["v"] == [4.0, 5.0]
    weighted = df.withColumn("n", F.when(F.col("v")[0] == 8.0, 2).otherwise(1))
    assert vectors.mean_by_key(weighted, "k", "v", "n").first()["v"] == [5.0, 6.0]


def test_unknown_words_get_stable_bounded_vectors(spark):
    vocab = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "word string, word_id int")
    known = spark.createDataFrame([("a", [9.0] * 300)], "word string, vector array<float>")
    one = {r["word"]: r for r in vectors.vocabulary_vectors(vocab, known, 300).collect()}
    two = {r["word"]: r for r in vectors.vocabulary_vectors(vocab.repartition(3), known, 300).collect()}
    assert one["a"]["vector"] == [9.0] * 300 and one["a"]["known"]
    assert one["b"]["vector"] == two["b"]["vector"] != one["c"]["vector"]
    values = np.array(one["b"]["vector"])
    assert abs(values).max() <= 0.25 and values.std() > 0.1
    assert [r["word"] for r in vectors.unknown_words(vocab, known).orderBy("word").collect()] == ["b", "c"]


@pytest.mark.parametrize("limit", [0, 100])
def test_pooled_vectors_keep_documents_without_words(spark, monkeypatch, limit):
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", limit)
    enc = spark.createDataFrame([(1, [1, 2, 1]), (2, []), (3, [9])], "d long, ids array<int>")
    table = spark.createDataFrame([(1, [1.0, 0.0]), (2, [4.0, 3.0])], "word_id int, vector array<float>")
    out = {r["d"]: r["vector"] for r in vectors.pooled(enc, "d", table).collect()}
    assert out == {1: [2.0, 1.0], 2: None, 3: None}


def test_naive_bayes_hand_computed_and_like_ml(spark):
    rows = [(0, "p", ["a", "b", "b"]), (1, "p", ["b"]), (2, "q", ["b", "c", "c", "c"])]
    docs = spark.createDataFrame(rows, "d long, l string, t array<string>")
    classes, terms = bayes.fit(docs, vocabulary.term_counts(docs, "t", "l"), "l")
    pi = {r["l"]: r["pi"] for r in classes.collect()}
    assert pi == pytest.approx({"p": math.log(3 / 5), "q": math.log(2 / 5)})
    theta = {(r["l"], r["term"]): r["theta"] for r in bayes.theta(classes, terms, "l").collect()}
    assert theta[("p", "a")] == pytest.approx(math.log(2 / 7))
    assert theta[("p", "b")] == pytest.approx(math.log(4 / 7))
    names = ["a", "b", "c"]
    ml_rows = CountVectorizerModel.from_vocabulary(names, inputCol="t", outputCol="features").transform(
        docs.withColumn("label", (F.col("l") == "q").cast("double"))
    )
    model = NaiveBayes(smoothing=1.0).fit(ml_rows)
    for k, label in enumerate("pq"):
        for j, term in enumerate(names):
            assert theta[(label, term)] == pytest.approx(model.theta.toArray()[k, j])
    test = spark.createDataFrame([(7, ["c", "zzz"]), (8, []), (9, ["a", "a"])], "d long, t array<string>")
    scores = bayes.score(test, vocabulary.term_counts(test, "t", "d"), "d", classes, terms, "l")
    got = {r["d"]: (r["prediction"], r["score"]) for r in bayes.predict(scores, "d").collect()}
    assert got[7] == ("q", pytest.approx(math.log(2 / 5) + math.log(4 / 7)))
    assert got[8] == ("p", pytest.approx(math.log(3 / 5)))
    assert got[9] == ("p", pytest.approx(math.log(3 / 5) + 2 * math.log(2 / 7)))


def test_label_ids(spark):
    rows = spark.createDataFrame([(5, "b"), (1, "c"), (3, "a"), (9, "c")], "k long, l string")
    want = {"c": 0, "a": 1, "b": 2}
    ids = labels.first_seen_ids(rows, "l", "k")
    assert {r["l"]: r["label_id"] for r in ids.collect()} == want
    keyed = rows.withColumn("s", F.struct(F.col("k").cast("string").alias("a"), "l"))
    assert {r["l"]: r["label_id"] for r in labels.first_seen_ids(keyed, "l", "s").collect()} == want
    coded = labels.with_label_id(rows, ids, "l", "k")
    back = labels.with_label_name(coded.drop("l"), ids, "label_id", "k")
    assert {(r["k"], r["l"]) for r in back.collect()} == {(5, "b"), (1, "c"), (3, "a"), (9, "c")}
    model = labels.frequency_ids(rows, "l")
    assert list(model.labels) == ["c", "a", "b"]
    pairs = labels.class_pairs(rows, "l", "x", "y").collect()
    assert len(pairs) == 6 and all(r["x"] != r["y"] for r in pairs)


@pytest.mark.parametrize("labelled", [["x", "x"], ["x", None], ["x", "y"]])
def test_chi_square_with_one_class_or_no_label(spark, labelled):
    rows = spark.createDataFrame([(i, lab, "t", 1.0) for i, lab in enumerate(labelled)], "d long, l string, term string, weight double")
    scored = weights.chi_square(rows, "l", weights.class_shares(rows, "l")).collect()
    assert {r["l"] for r in scored} == {lab for lab in labelled if lab}
    assert all(r["chi2"] == 0 for r in scored)


def test_lookup_joins_int_with_long_keys(spark):
    from labelloom.operators.lookup import lookup

    table = spark.range(3000).select(F.col("id").alias("k"), F.lit(1).alias("n"), (F.col("id") * 2).alias("v"))
    facts = spark.range(3000).select(F.col("id").cast("int").alias("k"), F.col("id").alias("s"))
    found = lookup(facts, table, "k", "s", "n", broadcast_bytes=10)
    assert found.filter("v = 2 * k").count() == 3000

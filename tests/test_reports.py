"""Reports of fitted models, in-row layouts and fold counts against brute force."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.ml.linalg import SparseVector
from pyspark.sql import functions as F

from labelloom.operators import bayes, evaluation, keyed, splits, statistics, vectors, vocabulary, weights
from labelloom.operators.statistics import scalar_count
from labelloom.plans import models
from labelloom.storage import written


@pytest.fixture(scope="module")
def run(spark, small):
    return models.SvcRun(spark, small)


def test_reports_share_one_table_of_predictions(run):
    rows = run.predictions.collect()
    cells = Counter((r["sentiment"], r["predicted"]) for r in rows)
    assert {(c["actual"], c["predicted"]): c["n"] for c in run.cells.collect() if c["n"]} == dict(cells)
    report = {r["class"]: r for r in run.report().collect()}
    for name in {r["sentiment"] for r in rows}:
        hit = cells[name, name]
        claimed = sum(n for (_, p), n in cells.items() if p == name)
        support = sum(n for (a, _), n in cells.items() if a == name)
        precision, recall = hit / claimed if claimed else 0, hit / support
        assert report[name]["precision"] == pytest.approx(precision) and report[name]["recall"] == pytest.approx(recall)
        assert report[name]["support"] == support
    right = sum(n for (a, p), n in cells.items() if a == p)
    assert report["accuracy"]["precision"] == pytest.approx(right / len(rows)) and right > 0.8 * len(rows)
    wrong = run.errors(1).collect()
    assert {r["doc_id"] for r in wrong} == {r["doc_id"] for r in rows if r["sentiment"] != r["predicted"]}


def test_errors_list_frequent_pairs_only(spark):
    class Fixed(models.SvcRun):
        def __init__(self):
            data = [(i, "a", "b") for i in range(7)] + [(10 + i, "b", "a") for i in range(5)] + [(20 + i, "a", "a") for i in range(9)]
            self.predictions = spark.createDataFrame(data, "doc_id long, sentiment string, predicted string")
            self.cells = evaluation.confusion(self.predictions, "sentiment", "predicted")
            self.texts = self.predictions.select("doc_id", F.concat(F.lit("text "), "doc_id").alias("content"))

    rows = Fixed().errors().collect()
    assert {r["doc_id"] for r in rows} == set(range(7)) and all(r["n"] == 7 and r["content"] == f"text {r['doc_id']}" for r in rows)


def test_refit_names_sentences(spark, small, run):
    some = spark.read.parquet(f"{small}/documents.parquet").filter("length(text) > 300").limit(40)
    texts = some.select("doc_id", F.col("text").alias("content"), "lang")
    named = run.score_texts(run.refitted(), texts).collect()
    assert len(named) == 40 and sum(r["lang"] == r["predicted_sentiment"] for r in named) >= 38


def test_written_vectors_are_ml_vectors(spark):
    rows = spark.createDataFrame(
        [(1, [("b", 4, 0.5), ("a", 1, 2.0)]), (2, [])], "d long, terms array<struct<term:string,term_id:long,weight:double>>"
    ).select("d", vectors.sparse_vectors("terms", 6).alias("v"))
    got = {r["d"]: r["v"] for r in vectors.written_vectors(rows, "v", "vectors").collect()}
    assert got == {1: SparseVector(6, {1: 2.0, 4: 0.5}), 2: SparseVector(6, {})}


def murmur3(data: bytes, seed: int = 42) -> int:
    """MurmurHash3, 32 bits, as published; a signed number."""
    mask, h = 0xFFFFFFFF, seed

    def mix(k):
        k = k * 0xCC9E2D51 & mask
        return ((k << 15 | k >> 17) & mask) * 0x1B873593 & mask

    whole = len(data) // 4 * 4
    for at in range(0, whole, 4):
        h ^= mix(int.from_bytes(data[at : at + 4], "little"))
        h = ((h << 13 | h >> 19) & mask) * 5 + 0xE6546B64 & mask
    if len(data) > whole:
        h ^= mix(int.from_bytes(data[whole:], "little"))
    h ^= len(data)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ h >> shift) * factor & mask
    return h - 2**32 if h >= 2**31 else h


def test_hashed_counts_and_idf(spark, small):
    from labelloom.operators import training
    from labelloom.plans import features
    from labelloom.plans import tables as t

    words = {r["doc_id"]: r["tokens"] for r in t.words(spark, small).collect()}
    want = Counter((d, murmur3(w.encode()) % 10_000) for d, tokens in words.items() for w in tokens)
    got = {(r["doc_id"], r["bucket"]): r["tf"] for r in features.vec_hashing_buckets(spark, small).collect()}
    assert got == dict(want)
    rows = models.split_tweets(spark, small)
    fitted = training.fit_features(training.hash_idf_stages(), rows)
    idf = fitted.stages[3].idf.toArray()
    kept = fitted.transform(rows).filter("split = 'train'").select("filtered").collect()
    df = Counter(b for r in kept for b in {murmur3(w.encode()) % 10_000 for w in r["filtered"]})
    for b in range(10_000):
        expected = math.log((len(kept) + 1) / (df[b] + 1)) if df[b] >= training.MIN_DF else 0.0
        assert idf[b] == pytest.approx(expected)


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line or "Exchange RoundRobin" in line]


@pytest.fixture
def fixed_plans(spark):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", before)


def test_tfidf_lays_documents_out_once(spark, fixed_plans):
    docs = spark.createDataFrame([(i, f"a b w{i % 7} w{i % 3}".split()) for i in range(50)], "d long, t array<string>")
    rows = written(vocabulary.document_terms(docs, "t", "d"), "document-terms")
    fitted = weights.idf_table(rows.select(F.inline("terms")), scalar_count(docs), 1)
    scored = weights.tfidf(rows, "d", scalar_count(docs), fitted=fitted)
    assert len(exchanges(scored)) == 1 and "Window" not in scored._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("within", [[], ["g"]])
def test_ranks_lay_rows_out_once(spark, fixed_plans, within):
    df = written(spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 2).alias("g")), "rows")
    ranked = keyed.hash_rank(df, "id", 5, within, digits=1)
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    # The rows' side of the join: below its window one exchange.
    side = plan[: plan.index("BroadcastExchange")] if "BroadcastExchange" in plan else plan.split("Window")[1]
    assert side.count("Exchange hashpartitioning(_g") == 1
    groups = defaultdict(list)
    for r in ranked.collect():
        groups[r["g"] if within else 0].append(r["rank"])
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in groups.values())


def test_corpus_stats_and_text_counts(spark):
    rows = [("x", "a b a"), ("x", ""), ("y", "c b"), ("y", "a b a")]
    df = spark.createDataFrame(rows, "l string, t string").withColumn("w", F.array_remove(F.split("t", " "), ""))
    got = statistics.corpus_stats(df, "l", "w").first()
    assert (got["documents"], got["words"], got["vocabulary"], got["per_class"]) == (4, 8, 3, {"x": 2, "y": 2})
    texts = spark.createDataFrame([("a",), ("b",), ("a",), (None,), (None,), (None,), ("",)], "t string")
    assert [tuple(r) for r in statistics.counts_by_text(texts, "t").collect()] == [(None, 3), ("a", 2), ("", 1), ("b", 1)]


def test_box_plot_reads_its_input_once(spark):
    r = random.Random(4)
    data = [("g" if i % 5 else "h", round(r.gauss(0, 1), 1)) for i in range(400)] + [("g", 50.0), ("g", None), (None, 1.0)]
    df = spark.createDataFrame(data, "g string, v double")
    got = {row["g"]: row for row in statistics.box_plot(df, "g", "v").collect()}
    values = sorted(v for g, v in data if g == "g" and v is not None)

    def quantile(q):
        at = q * (len(values) - 1)
        low = values[int(at)]
        return low + (values[min(int(at) + 1, len(values) - 1)] - low) * (at - int(at))

    q1, q3 = quantile(0.25), quantile(0.75)
    inside = [v for v in values if q1 - 1.5 * (q3 - q1) <= v <= q3 + 1.5 * (q3 - q1)]
    row = got["g"]
    assert (row["q1"], row["median"], row["q3"]) == pytest.approx((q1, quantile(0.5), q3))
    assert (row["n"], row["outliers"], row["lowest"], row["highest"]) == (len(values), len(values) - len(inside), values[0], 50.0)
    assert (row["whisker_low"], row["whisker_high"]) == (inside[0], inside[-1])


def test_fold_counts_equal_fits_without_the_fold(spark):
    r = random.Random(7)
    words = {"p": "a b c d", "q": "b c d e f", "s": "a f g"}
    data = []
    for i in range(90):
        label = "pqs"[i % 3]
        own = words[label].split()
        data.append((i, label, i % 4, [r.choice(own if r.random() < 0.6 else "abcdefgh") for _ in range(r.randrange(0, 9))]))
    df = spark.createDataFrame(data, "d long, l string, f int, t array<string>")
    rows = written(vocabulary.document_terms(df, "t", "d", "l", "f"), "document-terms")
    got = {(x["fold"], x["smoothing"]): (x["rows"], x["hits"]) for x in bayes.cross_validate(rows, "d", "l", "f", 4, [0.5, 2.0]).collect()}
    for fold in range(4):
        train, test = [x for x in data if x[2] != fold], [x for x in data if x[2] == fold]
        counts = {k: Counter(w for x in train if x[1] == k for w in x[3]) for k in "pqs"}
        seen = set().union(*counts.values())
        for s in (0.5, 2.0):
            hits = 0
            for _, label, _, tokens in test:
                scores = {}
                for k in "pqs":
                    n = sum(x[1] == k for x in train)
                    bottom = math.log(sum(counts[k].values()) + s * len(seen))
                    scores[k] = math.log(n + s) - math.log(len(train) + 3 * s) + sum(
                        math.log(counts[k][w] + s) - bottom for w in tokens if w in seen
                    )
                hits += max("pqs", key=lambda k: scores[k]) == label
            assert got[fold, s] == (len(test), hits)


def test_batches_of_epochs(spark):
    out = splits.batch_assign_all(spark.range(100), "id", 16, 3).groupBy("epoch", "batch").count().collect()
    assert {(r["epoch"], r["batch"]): r["count"] for r in out} == {(e, b): 16 if b < 6 else 4 for e in range(3) for b in range(7)}

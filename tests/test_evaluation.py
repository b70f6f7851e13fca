import numpy as np
import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from labelloom.operators import evaluation, keyed, statistics


@pytest.fixture(scope="module")
def predictions(spark):
    # Class 2 is never predicted, class 3 has no support.
    rows = [(0, 0)] * 5 + [(0, 1)] * 6 + [(1, 1)] * 4 + [(1, 3)] * 2 + [(2, 0)] * 3
    return spark.createDataFrame(rows, "actual int, predicted int").cache()


def test_confusion_is_dense(predictions):
    cells = {(r["actual"], r["predicted"]): r["n"] for r in evaluation.confusion(predictions, "actual", "predicted").collect()}
    assert len(cells) == 16
    assert cells[(0, 1)] == 6 and cells[(2, 2)] == 0 and cells[(3, 3)] == 0
    wide = evaluation.confusion_wide(predictions, "actual", "predicted", [0, 1, 2, 3])
    row = wide.filter("actual = 0").first()
    assert [row[str(k)] for k in range(4)] == [5, 6, 0, 0]


def test_confused_pairs(predictions):
    rows = evaluation.confused_pairs(evaluation.confusion(predictions, "actual", "predicted")).collect()
    assert [tuple(r) for r in rows] == [(0, 1, 6)]


def test_report_zeroes_and_evaluator(predictions):
    cells = evaluation.confusion(predictions, "actual", "predicted")
    rows = {r["class"]: r for r in evaluation.class_report(cells).collect()}
    assert rows["2"]["precision"] == rows["2"]["recall"] == rows["2"]["f1"] == 0.0
    assert rows["3"]["support"] == 0 and rows["3"]["recall"] == 0.0
    assert rows["0"]["precision"] == pytest.approx(5 / 8)
    doubles = predictions.select(F.col("actual").cast("double").alias("label"), F.col("predicted").cast("double").alias("prediction"))
    for metric, value in [("accuracy", rows["accuracy"]["f1"]), ("f1", rows["weighted avg"]["f1"])]:
        assert MulticlassClassificationEvaluator(metricName=metric).evaluate(doubles) == pytest.approx(value)
    assert evaluation.weighted_f1(cells).first()["f1"] == pytest.approx(rows["weighted avg"]["f1"])
    assert evaluation.accuracy(predictions, "actual", "predicted").first()[0] == pytest.approx(9 / 20)


def test_most_confident_rows(spark):
    rows = [(i, 0 if i % 2 else 1, [i / 10, 1 - i / 10]) for i in range(10)]
    df = spark.createDataFrame(rows, "id int, prediction int, probability array<double>")
    top = evaluation.most_confident(df, "id", 0, 2).collect()
    assert [r["id"] for r in top] == [9, 7]


def test_histogram_edges(spark):
    df = spark.createDataFrame([(x,) for x in [0, 1, 10, 10]], "x int")
    bins = statistics.histogram(df, "x", 5).orderBy("bin").collect()
    assert [r["n"] for r in bins] == [2, 0, 0, 0, 2]
    flat = statistics.histogram(spark.createDataFrame([(4,), (4,)], "x int"), "x", 4).orderBy("bin").collect()
    assert sum(r["n"] for r in flat) == 2 and (flat[0]["low"], flat[-1]["high"]) == (3.5, 4.5)
    assert statistics.histogram(df.limit(1), "x", 50).count() == 50


@pytest.mark.parametrize("buckets", [1, 7, 1024])
def test_quantiles_of_a_hot_group(spark, monkeypatch, buckets):
    monkeypatch.setattr(keyed.value_buckets, "__defaults__", (buckets,))
    rng = np.random.default_rng(1)
    data = [("hot", float(x)) for x in rng.exponential(size=1500)] + [("hot", 1.0)] * 700
    data += [(f"g{i % 9}", float(round(x, 1))) for i, x in enumerate(rng.normal(size=200))] + [("one", 5.0)]
    df = spark.createDataFrame(data, "g string, x double")
    got = {(r["g"], r["q"]): r["value"] for r in statistics.group_quantiles(df, "g", "x").collect()}
    for g in {k for k, _ in data}:
        values = [x for k, x in data if k == g]
        for q in (0.25, 0.5, 0.75):
            assert got[(g, q)] == pytest.approx(np.quantile(values, q))


def test_box_plot_whiskers(spark):
    values = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 100.0]
    df = spark.createDataFrame([("m", v) for v in values], "m string, x double")
    row = statistics.box_plot(df, "m", "x").first()
    assert (row["whisker_low"], row["whisker_high"], row["outliers"], row["n"]) == (1.0, 7.0, 1, 8)


def test_corpus_statistics(spark):
    df = spark.createDataFrame([("t", ["a", "b"]), ("t", ["a"]), ("d", [])], "l string, w array<string>")
    row = statistics.corpus_stats(df, "l", "w").first()
    assert (row["documents"], row["words"], row["vocabulary"]) == (3, 3, 2)
    assert row["per_class"] == {"t": 2, "d": 1} and row["mean_words"] == 1.0


def test_losses(spark):
    df = spark.createDataFrame([([0.0, 0.0], 0), ([0.0, 0.0], 1)], "s array<double>, l int")
    assert evaluation.log_loss(df, "s", "l").first()[0] == pytest.approx(np.log(2))
    w = spark.createDataFrame([(3.0,), (4.0,)], "w double")
    assert evaluation.l2_penalty(w, "w", 0.1).first()[0] == pytest.approx(1.25)


def test_missing_predictions_are_a_class(spark):
    df = spark.createDataFrame([("a", "a"), ("a", None), (None, "a")], "actual string, predicted string")
    cells = {(r["actual"], r["predicted"]): r["n"] for r in evaluation.confusion(df, "actual", "predicted").collect()}
    assert cells == {("a", "a"): 1, ("a", None): 1, (None, "a"): 1, (None, None): 0}

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from labelloom.operators import evaluation, shards, splits, training
from labelloom.plans import registered
from labelloom.sources import readers, writers

WORDS = {"joy": ["happy", "sunny", "great"], "sad": ["cry", "rain", "lost"], "dull": ["queue", "form", "wait"]}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    data = []
    for i in range(240):
        label = ["joy", "sad", "dull"][min(int(rng.integers(0, 4)), 2)]
        words = rng.choice(WORDS[label] + ["the", "day", "is"], 8)
        data.append((i, label, " ".join(words), ))
    data.append((999, "joy", None))
    df = spark.createDataFrame(data, "tweet_id long, sentiment string, content string")
    return splits.split_random(df, "tweet_id", {"train": 0.7, "test": 0.3}).cache()


@pytest.fixture(scope="module")
def features(rows):
    return training.fit_features(training.count_stages(min_df=2), rows)


@pytest.fixture(scope="module")
def parts(rows, features):
    ready = features.transform(rows.filter("content is not null")).select(
        "tweet_id", "split", "sentiment", "content", "features", "label"
    ).cache()
    return ready.filter("split = 'train'"), ready.filter("split = 'test'")


def majority(test):
    top = test.groupBy("label").count().agg(F.max("count"), F.sum("count")).first()
    return top[0] / top[1]


@pytest.mark.parametrize(
    "make", [training.logistic_regression, training.naive_bayes, training.random_forest, training.linear_svc]
)
def test_models_beat_the_majority_class(parts, make):
    train, test = parts
    model = training.fit_kept(make(), train)
    scored = model.transform(test)
    accuracy = evaluation.accuracy(scored, "label", "prediction").first()[0]
    assert accuracy > majority(test) + 0.1
    assert scored.count() == test.count()


def test_fit_on_train_or_all(rows):
    train_only = training.fit_features(training.count_stages(min_df=1), rows)
    everything = training.fit_features(training.count_stages(min_df=1), rows, fit_on=None)
    assert len(train_only.stages[2].vocabulary) <= len(everything.stages[2].vocabulary)


def test_hashing_keeps_the_token_mass(spark):
    df = spark.createDataFrame([(["a", "b", "a"],), ([],)], "t array<string>")
    out = HashingTF(inputCol="t", outputCol="v", numFeatures=10_000).transform(df)
    sums = [sum(r["v"]) for r in out.select(vector_to_array("v").alias("v")).collect()]
    assert sums == [3.0, 0.0]


def test_hash_idf_stages(rows):
    fitted = training.fit_features(training.hash_idf_stages(min_df=1), rows)
    out = fitted.transform(rows.filter("content is not null"))
    assert out.filter("features is null").count() == 0


def test_label_names_and_adhoc_texts(spark, parts, features):
    model = training.fit_kept(training.naive_bayes(), parts[0])
    texts = readers.inline_rows(spark, ["happy sunny day", "rain and cry", "wait in the queue"])
    out = training.score_texts(features, model, texts).orderBy("doc_id").collect()
    assert [r["predicted_sentiment"] for r in out] == ["joy", "sad", "dull"]


def test_save_keeps_five_and_restores_the_latest(spark, parts, features, tmp_path):
    train, test = parts
    model = training.fit_kept(training.naive_bayes(), train)
    whole = PipelineModel([*features.stages, model])
    run = str(tmp_path / "run")
    for step in range(100, 800, 100):
        writers.save_model(spark, whole, run, step)
    steps = [r["step"] for r in writers.saved_steps(spark, run).collect()]
    assert steps == [700, 600, 500, 400, 300]
    step, back = writers.load_latest(spark, run)
    texts = test.select("tweet_id", "sentiment", "content")
    a = whole.transform(texts).select("tweet_id", "prediction")
    b = back.transform(texts).select("tweet_id", "prediction")
    assert step == 700 and a.exceptAll(b).count() == 0


def test_tuning_uses_the_fold_column(spark, parts, monkeypatch):
    monkeypatch.setattr(training, "GRID_REG", [0.1, 5.0])
    monkeypatch.setattr(training, "GRID_ELASTIC", [0.0])
    train = splits.fold_random(parts[0], "tweet_id", 3)
    model = training.tune(train, "fold", folds=3, maxIter=5)
    results = training.grid_results(model, spark).collect()
    assert len(results) == 2 and all(0 <= r["f1"] <= 1 for r in results)


def test_comparison_has_one_row_per_model_and_fold(parts):
    folded = splits.fold_stratified(parts[0], "tweet_id", "label", 3)
    out = training.compare_models(
        folded, {"nb": training.naive_bayes(), "lr": training.logistic_regression()}, "fold", 3
    ).collect()
    assert {(r["model_name"], r["fold_idx"]) for r in out} == {(m, i) for m in ("nb", "lr") for i in range(3)}
    assert all(0 < r["accuracy"] <= 1 for r in out)


def test_coefficients_name_the_typical_words(spark, parts, features):
    model = training.fit_kept(training.linear_svc(), parts[0])
    names = features.stages[2].vocabulary
    terms = spark.createDataFrame([(w, i) for i, w in enumerate(names)], "term string, term_id int")
    table = training.coefficients(model, terms, training.label_order(features))
    for label, words in WORDS.items():
        best = table.filter(F.col("label") == label).orderBy(F.desc("weight")).first()["term"]
        assert best in words


def test_steps_are_scored_in_one_scan(parts):
    train, test = parts
    rows = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    models = [training.logistic_regression(maxIter=k).fit(train) for k in (1, 2, 6)]
    out = training.steps_metrics(models, rows)
    got = {(r["step"], r["series"]): r for r in out.collect()}
    assert set(got) == {(k, s) for k in (1, 2, 3) for s in ("train", "dev")}
    losses = [got[k, "train"]["loss"] for k in (1, 2, 3)]
    assert losses[0] > losses[1] > losses[2]
    for k, model in enumerate(models, 1):
        hit = evaluation.accuracy(model.transform(test), "label", "prediction").first()[0]
        assert got[k, "dev"]["accuracy"] == pytest.approx(hit)


def test_network_over_vectors(spark):
    rng = np.random.default_rng(2)
    data = [(float(y), [float(v) for v in rng.normal(loc=2.0 * y, size=4)]) for y in rng.integers(0, 2, 200)]
    df = spark.createDataFrame(data, "label double, v array<double>").select(
        "label", array_to_vector("v").alias("features")
    )
    model = training.fit_kept(training.perceptron(4, 5, 2), df)
    assert evaluation.accuracy(model.transform(df), "label", "prediction").first()[0] > 0.9


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(3)
    centres = np.array([[2, 0], [-2, 1], [0, -3]])
    data = []
    for i in range(600):
        y = int(rng.integers(0, 3))
        data.append((i, [float(v) for v in centres[y] + rng.normal(scale=0.5, size=2)], y))
    return spark.createDataFrame(data, "id long, x array<double>, y int").cache()


def weights_of(df):
    return {(r["param"], r["idx"]): r["value"] for r in df.collect()}


def test_shards_learn_and_averaging_works(numbers):
    trained = shards.train_shards(numbers, "id", "x", "y", 2, 3, shards=4)
    assert {r["rows"] for r in trained.select("rows").distinct().collect()} == {150}
    averaged = shards.mean_weights(trained)
    by_hand = {}
    for r in trained.collect():
        by_hand.setdefault((r["param"], r["idx"]), []).append(r["value"])
    assert weights_of(averaged) == pytest.approx({k: float(np.mean(v)) for k, v in by_hand.items()})
    scored = shards.score_linear(numbers, "x", averaged, 2, 3)
    best = F.array_position("scores", F.array_max("scores")) - 1
    assert scored.agg(F.avg((best == F.col("y")).cast("double"))).first()[0] > 0.9


def test_one_shard_average_is_that_shard(numbers):
    trained = shards.train_shards(numbers, "id", "x", "y", 2, 3, shards=1)
    assert weights_of(shards.mean_weights(trained)) == pytest.approx(weights_of(trained))


def test_shard_training_does_not_depend_on_partitions(numbers):
    one = weights_of(shards.mean_weights(shards.train_shards(numbers, "id", "x", "y", 2, 3, 3)))
    again = shards.train_shards(numbers.repartition(5), "id", "x", "y", 2, 3, 3)
    assert one == pytest.approx(weights_of(shards.mean_weights(again)), abs=1e-4)


def test_left_over_rows_are_trained_too(spark, numbers):
    few = numbers.filter("id < 5")
    trained = shards.train_shards(few, "id", "x", "y", 2, 3, shards=3)
    sizes = trained.select("shard", "rows").distinct().collect()
    assert sum(r["rows"] for r in sizes) == 5 and len(sizes) == 5


def test_wide_fits_wait_for_one_another(spark, monkeypatch):
    heap = spark._jvm.java.lang.Runtime.getRuntime().maxMemory()
    assert training.fits_at_once(spark, 1000) == 4 and training.fits_at_once(spark, 0) == 4
    one = 8 * training.FIT_VECTORS
    assert training.fits_at_once(spark, heap // one) == training.fits_at_once(spark, 10**9) == 1
    assert training.fits_at_once(spark, heap // 2 // one // 3) == 3
    asked = []
    monkeypatch.setattr(training, "fits_at_once", lambda spark, width, most=4: asked.append(width) or 1)
    real, given = training.linear_svc, []
    monkeypatch.setattr(training, "linear_svc", lambda parallelism=4, **p: given.append(parallelism) or real(parallelism, maxIter=2, **p))
    assert registered()["top_coef_per_class"](spark, "/root/testdata/sf0.001").count() == 16
    assert registered()["ml_svc_report"](spark, "/root/testdata/sf0.001").count() == 7
    assert given == [1, 1] and len(asked) == 2 and min(asked) > 100

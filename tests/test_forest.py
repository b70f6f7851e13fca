import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from labelloom.operators import training
from labelloom.operators.forest import SparseForest


def table(spark, rows):
    return spark.createDataFrame([(float(y), x) for y, x in rows], ["label", "features"])


def accuracy(model, df):
    return model.transform(df).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]


@pytest.fixture(scope="module")
def drawn(spark):
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(600):
        y = int(rng.integers(0, 3))
        at = {int(f): float(rng.integers(1, 4)) for f in rng.choice(60, 6, replace=False)}
        at |= {60 + y: 2.0} if rng.random() < 0.8 else {}
        rows.append((y, Vectors.sparse(64, at)))
    return table(spark, rows).repartition(3).cache()


def test_as_good_as_the_dense_forest(drawn):
    mine = accuracy(SparseForest(numTrees=40, maxDepth=4).fit(drawn), drawn)
    other = accuracy(RandomForestClassifier(numTrees=40, maxDepth=4, seed=0).fit(drawn), drawn)
    assert mine > 0.7 and mine > other - 0.05


def test_the_cut_of_one_tree(spark):
    # One feature tells the classes apart, by its amount; all rows with 3 or more are of class 1.
    rows = [(int(v >= 3), Vectors.sparse(1, {0: float(v)})) for v in range(1, 6) for _ in range(20)]
    model = SparseForest(numTrees=1, maxDepth=2).fit(table(spark, rows))
    assert model.feature[0, 0] == 0 and model.limit[0, 0] == 2.5
    assert accuracy(model, table(spark, rows)) == 1


def test_zeros_negatives_and_dense_rows(spark):
    rows = [(0, Vectors.sparse(2, {})), (1, Vectors.sparse(2, {0: -1.0})), (2, Vectors.dense([2.0, 0.0]))] * 20
    model = SparseForest(numTrees=5, maxDepth=3).fit(table(spark, rows))
    assert accuracy(model, table(spark, rows)) == 1


def test_one_class_and_no_features(spark):
    for rows in ([(0, Vectors.sparse(3, {1: 1.0}))] * 4, [(0, Vectors.sparse(3, {})), (0, Vectors.sparse(3, {}))]):
        assert accuracy(training.random_forest(numTrees=3).fit(table(spark, rows)), table(spark, rows)) == 1


def test_wide_rows_stay_sparse(spark):
    # As dense bins these rows would take 20 GB; the fit keeps a few megabytes.
    width = 500_000
    df = spark.range(10_000).select(
        (F.col("id") % 2).cast("double").alias("label"),
        F.array((F.col("id") * 48_271) % width, width + F.col("id") % 2).alias("at"),
    )
    one = F.udf(lambda at: Vectors.sparse(width + 2, {int(a): 1.0 for a in at}), training_vector())
    rows = df.select("label", one("at").alias("features")).cache()
    model = training.random_forest(numTrees=8, maxDepth=2).fit(rows)
    assert (model.feature[:, 0] >= 0).any()
    assert model.transform(rows).filter("prediction is null").count() == 0


def training_vector():
    from pyspark.ml.linalg import VectorUDT

    return VectorUDT()

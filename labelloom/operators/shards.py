"""Training per shard and averaging the parameters.

Every shard is a folder of rows on which one Spark ML model is fitted; a few fits run at a
time, each of them distributed. The number of shards is the caller's.
"""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.operators.splits import shard_equal
from labelloom.storage import new_path

WEIGHTS = "shard int, rows long, param string, idx int, value double"


def train_shards(
    df: DataFrame, key: str, features: str, label: str, dims: int, classes: int,
    shards: int, seed: object = 0, parallelism: int = 4, **params,
) -> DataFrame:
    """``(shard, rows, param, idx, value)``: the softmax weights each shard arrives at.

    ``features`` is an array of ``dims`` numbers, ``label`` an integer below ``classes``.
    ``param`` is ``weight`` or ``bias``, ``idx`` the position in row-major order. The
    driver holds ``shards x (dims + 1) x classes`` numbers.
    """
    spark = df.sparkSession
    rows = shard_equal(
        df.select(key, array_to_vector(F.col(features)).alias("x"), F.col(label).cast("double").alias("y")),
        key, shards, seed,
    )
    path = new_path(spark, "shards")
    rows.write.partitionBy("shard").parquet(path)
    # All shards know all classes, also those that a shard has no row of.
    names = {"ml_attr": {"type": "nominal", "vals": [str(c) for c in range(classes)]}}
    placed = spark.read.parquet(path).withColumn("y", F.col("y").alias("y", metadata=names))
    sizes = [(r["shard"], r["n"]) for r in placed.groupBy("shard").agg(F.count("*").alias("n")).collect()]
    settings = {"family": "multinomial", "regParam": 0.01} | params

    def fit(shard: tuple[int, int]) -> list[tuple]:
        number, size = shard
        model = LogisticRegression(featuresCol="x", labelCol="y", **settings).fit(
            placed.filter(F.col("shard") == number)
        )
        weight, bias = model.coefficientMatrix.toArray().T.ravel(), model.interceptVector.toArray()
        return [
            (int(number), int(size), param, i, float(v))
            for param, values in (("weight", weight), ("bias", bias))
            for i, v in enumerate(values)
        ]

    with ThreadPool(parallelism) as pool:
        fitted = pool.map(inheritable_thread_target(spark)(fit), sizes)
    return spark.createDataFrame([w for weights in fitted for w in weights], WEIGHTS)


def mean_weights(weights: DataFrame) -> DataFrame:
    """``(param, idx, value)``: mean over shards, each counted by its rows."""
    return weights.groupBy("param", "idx").agg(
        (F.sum(F.col("value") * F.col("rows")) / F.sum("rows")).alias("value")
    )


def score_linear(
    df: DataFrame, features: str, averaged: DataFrame, dims: int, classes: int
) -> DataFrame:
    """Add ``scores`` from averaged weights, as a column expression.

    The weights travel as one scalar array: ``classes`` biases, then ``dims x classes``
    weights in row-major order.
    """
    weights = averaged.agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("param", "idx", "value"))),
            lambda e: e["value"],
        ).alias("w")
    ).scalar()
    scores = F.transform(
        F.sequence(F.lit(0), F.lit(classes - 1)),
        lambda c: F.aggregate(
            F.sequence(F.lit(0), F.lit(dims - 1)),
            F.element_at("_w", c + 1),
            lambda acc, d: acc
            + F.element_at(F.col(features), d + 1).cast("double")
            * F.element_at("_w", (d + 1) * classes + c + 1),
        ),
    )
    return df.withColumn("_w", weights).withColumn("scores", scores).drop("_w")

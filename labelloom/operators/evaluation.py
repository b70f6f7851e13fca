"""Confusion counts, class reports, losses and error listings."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions.arrays import cross_entropy


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """``(actual, predicted, n)`` for every pair of classes, absent pairs with 0.

    Rows are reduced to one count per seen pair; the full grid unfolds from the class
    list, so nothing is joined. A missing label or prediction is a class of its own, NULL.
    Labels must be few: all classes meet in one row, all pairs in the result.
    """
    seen = df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count("*").alias("n")
    )
    # From here on there are at most classes x classes entries.
    grid = seen.agg(
        F.array_sort(
            F.array_distinct(
                F.concat(
                    F.collect_set(F.struct(F.col("actual").alias("v"))),
                    F.collect_set(F.struct(F.col("predicted").alias("v"))),
                )
            )
        ).alias("_classes"),
        F.map_from_entries(
            F.collect_list(F.struct(F.struct("actual", "predicted"), "n"))
        ).alias("_n"),
    )
    cells = grid.select("_n", "_classes", F.explode("_classes").alias("_a")).select(
        "_n", "_a", F.explode("_classes").alias("_p")
    ).select("_n", F.col("_a.v").alias("actual"), F.col("_p.v").alias("predicted"))
    return cells.select(
        "actual", "predicted",
        F.coalesce(F.try_element_at("_n", F.struct("actual", "predicted")), F.lit(0)).alias("n"),
    )


def confusion_wide(df: DataFrame, actual: str, predicted: str, classes: list) -> DataFrame:
    """One row per actual class, one column per predicted class."""
    cells = confusion(df, actual, predicted)
    return cells.groupBy("actual").pivot("predicted", classes).agg(F.sum("n"))


def confused_pairs(cells: DataFrame, minimum: int = 6) -> DataFrame:
    """Off-diagonal cells with at least ``minimum`` rows, most frequent first."""
    return cells.filter(
        (F.col("actual") != F.col("predicted")) & (F.col("n") >= minimum)
    ).orderBy(F.desc("n"), "actual", "predicted")


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)


def class_scores(cells: DataFrame) -> DataFrame:
    """``(class, precision, recall, f1, support)`` from confusion cells; 0/0 counts as 0."""
    side = F.explode(
        F.array(
            F.struct(
                F.col("actual").alias("class"),
                F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("tp"),
                F.lit(0).cast("long").alias("claimed"),
                F.col("n").alias("support"),
            ),
            F.struct(
                F.col("predicted").alias("class"),
                F.lit(0).cast("long").alias("tp"),
                F.col("n").alias("claimed"),
                F.lit(0).cast("long").alias("support"),
            ),
        )
    )
    sums = cells.select(side.alias("e")).select("e.*").groupBy("class").agg(
        F.sum("tp").alias("tp"), F.sum("claimed").alias("claimed"), F.sum("support").alias("support")
    )
    rated = sums.select(
        "class", "support",
        _ratio(F.col("tp"), F.col("claimed")).alias("precision"),
        _ratio(F.col("tp"), F.col("support")).alias("recall"),
        "tp",
    )
    both = F.col("precision") + F.col("recall")
    return rated.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), both))


def class_report(cells: DataFrame) -> DataFrame:
    """Per-class scores plus the rows ``accuracy``, ``macro avg`` and ``weighted avg``."""
    scores = class_scores(cells)
    total = F.sum("support")

    def weighted(name: str) -> Column:
        return F.sum(F.col(name) * F.col("support")) / total

    hit = F.sum("tp") / total
    summary = scores.agg(
        F.array(
            F.struct(F.lit("accuracy").alias("class"), hit.alias("precision"),
                     hit.alias("recall"), hit.alias("f1"), total.alias("support")),
            F.struct(F.lit("macro avg").alias("class"), F.avg("precision").alias("precision"),
                     F.avg("recall").alias("recall"), F.avg("f1").alias("f1"),
                     total.alias("support")),
            F.struct(F.lit("weighted avg").alias("class"),
                     weighted("precision").alias("precision"), weighted("recall").alias("recall"),
                     weighted("f1").alias("f1"), total.alias("support")),
        ).alias("rows")
    ).select(F.explode("rows").alias("r")).select("r.*")
    columns = ["class", "precision", "recall", "f1", "support"]
    return (
        scores.withColumn("class", F.col("class").cast("string")).select(*columns)
        .unionByName(summary.select(*columns))
    )


def accuracy(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.agg(F.avg((F.col(actual) == F.col(predicted)).cast("double")).alias("accuracy"))


def weighted_f1(cells: DataFrame) -> DataFrame:
    return class_scores(cells).agg(
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1")
    )


def log_loss(df: DataFrame, scores: str, label: str) -> DataFrame:
    """Mean softmax cross-entropy of raw scores."""
    return df.agg(F.avg(cross_entropy(F.col(scores), F.col(label))).alias("log_loss"))


def l2_penalty(weights: DataFrame, value: str, strength: float) -> DataFrame:
    """``strength * sum(w^2) / 2`` over a table of weights."""
    half = F.sum(F.col(value) * F.col(value)) / 2
    return weights.agg((half * F.lit(strength)).alias("penalty"))


def misclassified(
    predictions: DataFrame, texts: DataFrame, key: str, actual: str, predicted: str
) -> DataFrame:
    """Wrongly predicted rows with their text."""
    wrong = predictions.filter(F.col(actual) != F.col(predicted))
    return wrong.join(texts, key)


def most_confident(
    predictions: DataFrame, key: str, klass: int, n: int = 10, probability: str = "probability"
) -> DataFrame:
    """The ``n`` rows predicted as ``klass`` with the highest probability for it."""
    p = F.col(probability)
    if predictions.schema[probability].dataType.typeName() != "array":
        p = vector_to_array(p)
    return (
        predictions.filter(F.col("prediction") == klass)
        .withColumn("confidence", F.element_at(p, klass + 1))
        .orderBy(F.desc("confidence"), key)
        .limit(n)
    )

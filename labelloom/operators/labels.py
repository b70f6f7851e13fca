"""Label dictionaries and one-hot targets."""

from __future__ import annotations

from pyspark.ml.feature import StringIndexer, StringIndexerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions.arrays import one_hot
from labelloom.operators.keyed import order_rank
from labelloom.operators.lookup import lookup


def first_seen_ids(df: DataFrame, label: str, key: str) -> DataFrame:
    """``(label, label_id, rows)``: ids 0, 1, ... in order of first appearance by key.

    The key may be a struct of several columns.
    """
    first = df.filter(F.col(label).isNotNull()).groupBy(label).agg(
        F.min(key).alias("_first"), F.count("*").alias("rows")
    )
    ranked = order_rank(first, "_first", "_r")
    return ranked.select(label, (F.col("_r") - 1).cast("int").alias("label_id"), "rows")


def frequency_ids(df: DataFrame, label: str) -> StringIndexerModel:
    """Label index with the most frequent label first, ties by name."""
    return StringIndexer(
        inputCol=label, outputCol="label", stringOrderType="frequencyDesc"
    ).fit(df)


def with_label_id(df: DataFrame, labels: DataFrame, label: str, key: str) -> DataFrame:
    """Add the id of each row's label."""
    return lookup(df, labels, label, key, "rows", how="left").drop("rows")


def with_label_name(df: DataFrame, labels: DataFrame, label_id: str, key: str) -> DataFrame:
    """Add the name belonging to each row's label id."""
    return lookup(df, labels, label_id, key, "rows", how="left").drop("rows")


def class_array(df: DataFrame, label: str) -> Column:
    """Scalar array of all classes, sorted; one entry per class."""
    return df.agg(F.array_sort(F.collect_set(label)).alias("classes")).scalar()


def with_one_hot(df: DataFrame, label: str, out: str) -> DataFrame:
    """One 0/1 entry per class, classes sorted by name."""
    classes = class_array(df, label)
    return df.withColumn("_classes", classes).withColumn(
        out, one_hot(F.col(label), F.col("_classes"))
    ).drop("_classes")


def class_pairs(df: DataFrame, label: str, first: str, second: str) -> DataFrame:
    """All ordered pairs of different classes.

    The pairs unfold from one array of the classes; no rows are joined.
    """
    classes = df.agg(F.array_sort(F.collect_set(label)).alias("_c"))
    return (
        classes.select("_c", F.explode("_c").alias(first))
        .select(first, F.explode("_c").alias(second))
        .filter(F.col(first) != F.col(second))
    )

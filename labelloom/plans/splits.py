"""Split, fold, shard and batch queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloom.operators import splits
from labelloom.operators.keyed import hash_threshold
from labelloom.plans import tables as t
from labelloom.plans.registry import query


def _orders(spark, sf):
    return t.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("label")
    )


_ORDERS = "SELECT o_orderkey AS id, o_orderpriority AS label FROM orders"


def _sql_ranked(seed: object, within: str = "") -> str:
    part = f"PARTITION BY {within} " if within else ""
    return (
        f"SELECT id, label, row_number() OVER ({part}ORDER BY {t.sql_hash('id', seed)}, id) AS rn, "
        f"count(*) OVER () AS n FROM ({_ORDERS})"
    )


@query(
    "split_random",
    f"SELECT id, CASE WHEN {t.sql_hash('id', 100)} < '{hash_threshold(0.7)}' THEN 'train' "
    f"ELSE 'test' END AS split FROM ({_ORDERS})",
)
def split_random(spark, sf):
    rows = _orders(spark, sf).select("id")
    return splits.split_random(rows, "id", {"train": 0.7, "test": 0.3}, seed=100)


_TWO = (
    "SELECT id, CASE WHEN rn <= ceil(n * {share}::DOUBLE) THEN 'test' ELSE 'train' END AS split "
    f"FROM ({_sql_ranked(0)})"
)


@query("split_exact_two", _TWO.format(share=0.33))
def split_exact_two(spark, sf):
    return splits.split_exact_two(_orders(spark, sf).select("id"), "id", 0.33)


_THREE = (
    "SELECT id, CASE WHEN rn <= floor(n * 0.1::DOUBLE) THEN 'test' "
    "WHEN rn <= 2 * floor(n * 0.1::DOUBLE) THEN 'validation' ELSE 'train' END AS split "
    f"FROM ({_sql_ranked(0)})"
)


@query("split_exact_three", _THREE)
def split_exact_three(spark, sf):
    return splits.split_exact_three(_orders(spark, sf).select("id"), "id", 0.1)


@query("agg_split_counts", f"SELECT split, count(*) AS n FROM ({_THREE}) GROUP BY split")
def agg_split_counts(spark, sf):
    parts = splits.split_exact_three(_orders(spark, sf).select("id"), "id", 0.1)
    return parts.groupBy("split").agg(F.count("*").alias("n"))


@query(
    "tail_holdout",
    f"WITH s AS ({_TWO.format(share=0.33)}), h AS (SELECT id FROM s WHERE split = 'test' "
    f"ORDER BY {t.sql_hash('id', 0)} DESC, id DESC LIMIT 1500) "
    "SELECT id, CASE WHEN id IN (SELECT id FROM h) THEN 'validation' ELSE split END AS split FROM s",
)
def tail_holdout(spark, sf):
    parts = splits.split_exact_two(_orders(spark, sf).select("id"), "id", 0.33)
    return splits.tail_holdout(parts, "id", 1500)


@query(
    "fold_stratified",
    "SELECT id, label, CAST((rn - 1) % 5 AS INTEGER) AS fold "
    f"FROM ({_sql_ranked(0, 'label')})",
)
def fold_stratified(spark, sf):
    return splits.fold_stratified(_orders(spark, sf), "id", "label", 5)


@query(
    "fold_random",
    f"SELECT id, CAST(CAST('0x' || {t.sql_hash('id', 0)}[1:8] AS BIGINT) % 5 AS INTEGER) AS fold "
    f"FROM ({_ORDERS})",
)
def fold_random(spark, sf):
    return splits.fold_random(_orders(spark, sf).select("id"), "id", 5)


@query(
    "shuffle_rows",
    f"SELECT id, label FROM ({_ORDERS}) ORDER BY {t.sql_hash('id', 7)}, id",
)
def shuffle_rows(spark, sf):
    return splits.shuffle_rows(_orders(spark, sf), "id", seed=7)


_SHARDS = f"SELECT id, CAST(floor((rn - 1) / (n // 7)) AS INTEGER) AS shard FROM ({_sql_ranked(0)})"


@query("shard_equal", _SHARDS)
def shard_equal(spark, sf):
    return splits.shard_equal(_orders(spark, sf).select("id"), "id", 7)


@query(
    "shard_repartition",
    f"SELECT shard, count(*) AS n, CAST(sum(id) AS BIGINT) AS id_sum, TRUE AS whole "
    f"FROM ({_SHARDS}) GROUP BY shard",
)
def shard_repartition(spark, sf):
    """All rows of a shard meet in one task, which streams through them."""
    rows = splits.shard_equal(_orders(spark, sf).select("id"), "id", 7)
    placed = rows.repartition(7, "shard").withColumn("_task", F.spark_partition_id())
    return placed.groupBy("shard").agg(
        F.count("*").alias("n"), F.sum("id").alias("id_sum"),
        (F.min("_task") == F.max("_task")).alias("whole"),
    )


# Fixed value: epochs of the review model.
EPOCHS = 100

_BATCHES = (
    "SELECT id, CAST(epoch AS INTEGER) AS epoch, CAST(floor((row_number() OVER (PARTITION BY epoch "
    "ORDER BY md5(concat('0:', epoch, ':', id)), id) - 1) / 64) AS BIGINT) AS batch "
    f"FROM ({_ORDERS}), range({EPOCHS}) e(epoch)"
)


@query("batch_assign_all", _BATCHES)
def batch_assign_all(spark, sf):
    return splits.batch_assign_all(_orders(spark, sf).select("id"), "id", 64, EPOCHS)


@query(
    "batch_assign_full",
    f"SELECT * FROM ({_BATCHES}) WHERE batch < (SELECT count(*) // 64 FROM orders)",
)
def batch_assign_full(spark, sf):
    return splits.batch_assign_full(_orders(spark, sf).select("id"), "id", 64, EPOCHS)

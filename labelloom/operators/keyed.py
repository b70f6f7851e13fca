"""Reproducible order, ranks and cut points from row keys.

Every shuffle, split, fold, shard and batch is decided by ``md5(seed:key)``: it does not
depend on how the data is partitioned, survives retries, and is uniform, so equal ranges
of it are equal shares of the rows whatever the keys or labels look like.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelloom.storage import written

# Buckets of the hash order: 16**4 counts are small for one task, and a bucket of 10**11
# rows still holds only 1.5 million.
BUCKET_DIGITS = 4
# Boundaries used to cut a numeric column into ranges.
RANGE_BUCKETS = 1024


def hash_key(key: str | Column, seed: object) -> Column:
    """Pseudo-random order of a key: 32 hex digits."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def hash_threshold(share: float) -> str:
    """Hex string below which a share of all hashes lies."""
    if share >= 1:
        return "g"
    return f"{math.floor(share * 16**13):013x}"


def _in_buckets(
    rows: DataFrame, within: Sequence[str], bucket: str, order: Sequence[str], value: Column, weight: Column, name: str
) -> DataFrame:
    """Add ``name``: ``value`` over the rows of a (group, bucket) up to this one, plus the
    weight of the group's earlier buckets; and ``_total``, the weight of the group.

    Rows are laid out once, by one key that is never NULL; the bucket sizes are laid out the
    same and merged with the rows where they are: their number grows with the groups, so they
    are not broadcast through the driver.
    """
    placed = rows.withColumn("_g", F.struct(*within, bucket))
    # One row per bucket: at most 16**BUCKET_DIGITS (or RANGE_BUCKETS) rows per group.
    counts = placed.groupBy("_g").agg(F.sum(weight).alias("_n"))
    groups = [F.col(f"_g.{c}") for c in within]
    earlier = W.partitionBy(*groups).orderBy(f"_g.{bucket}").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        F.col("_g").alias("_o"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_n").over(W.partitionBy(*groups)).alias("_total"),
    )
    inside = W.partitionBy("_g").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = placed.withColumn("_inside", value.over(inside))
    return (
        ranked.join(offsets.hint("merge"), ranked["_g"] == offsets["_o"])
        .withColumn(name, (F.col("_inside") + F.col("_before")).cast("long"))
        .drop("_g", "_o", "_inside", "_before")
    )


def hash_rank(
    df: DataFrame,
    key: str,
    seed: object,
    within: Sequence[str] = (),
    name: str = "rank",
    digits: int = BUCKET_DIGITS,
) -> DataFrame:
    """Rank rows 1, 2, ... in hash order, over all rows or within groups.

    The result equals ``row_number() over (partition by within order by hash, key)``, but
    no group goes through one task: rows are ranked inside (group, hash-prefix) buckets
    and shifted by the sizes of the earlier buckets. ``key`` must be unique.
    """
    # Rows without a key come first instead of falling out.
    rows = df.withColumn("_h", F.coalesce(hash_key(key, seed), F.lit("0" * 32))).withColumn(
        "_b", F.substring("_h", 1, digits)
    )
    return _in_buckets(rows, within, "_b", ["_h", key], F.row_number(), F.lit(1), name).drop("_h", "_b", "_total")


def order_rank(df: DataFrame, order: str, name: str = "rank") -> DataFrame:
    """Rank rows 1, 2, ... by a column of any type that can be sorted, structs too.

    Rows are laid out in ranges of the column and written, ranked inside their range and
    shifted by the sizes of the earlier ones.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = written(
        df.repartitionByRange(ranges, order).withColumn("_b", F.spark_partition_id()), "ranges"
    )
    sizes = placed.groupBy("_b").agg(F.count("*").alias("_n"))
    # One row per range.
    earlier = W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    before = sizes.select("_b", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = W.partitionBy("_b").orderBy(order)
    return (
        placed.withColumn("_place", F.row_number().over(inside)).join(F.broadcast(before), "_b")
        .withColumn(name, (F.col("_place") + F.col("_before")).cast("long"))
        .drop("_b", "_place", "_before")
    )


def value_buckets(df: DataFrame, column: str, buckets: int = RANGE_BUCKETS) -> DataFrame:
    """Add ``_b``: the range of ``column`` a row falls into, with about equal counts.

    The boundaries (at most ``buckets`` doubles) are fixed on the driver, so every later
    use of the result sees the same ranges.
    """
    shares = [i / buckets for i in range(1, buckets)]
    cuts = sorted(set(df.approxQuantile(column, shares, 1 / buckets))) if shares else []
    if not cuts:
        return df.withColumn("_b", F.lit(0.0))
    return Bucketizer(
        splits=[-math.inf, *cuts, math.inf], inputCol=column, outputCol="_b",
        handleInvalid="keep",
    ).transform(df)


def key_rank(
    df: DataFrame, key: str, within: Sequence[str] = (), name: str = "rank"
) -> DataFrame:
    """Rank rows 1, 2, ... in the order of a unique numeric key, over ranges of it."""
    rows = value_buckets(df.withColumn("_v", F.col(key).cast("double")), "_v")
    return _in_buckets(rows, within, "_b", [key], F.row_number(), F.lit(1), name).drop("_v", "_b", "_total")


def running_count(
    df: DataFrame, value: str, weight: str, within: Sequence[str], name: str
) -> DataFrame:
    """Running sum of ``weight`` in the order of ``value`` within groups, over ranges.

    Also adds ``_total``, the sum of the group.
    """
    rows = value_buckets(df, value)
    return _in_buckets(rows, within, "_b", [value], F.sum(weight), F.col(weight), name).drop("_b")


def hash_cut(df: DataFrame, key: str, seed: object, count: Column) -> Column:
    """The (hash, key) of the row at position ``count`` in hash order, as a scalar.

    ``count`` is an expression over ``_total``, the number of rows. Comparing a row's own
    (hash, key) with it splits a table at an exact position without moving any rows: only
    the keys of the one bucket that holds the position are sorted. NULL for position 0.
    """
    keys = df.select(F.col(key).alias("_k")).withColumn("_h", hash_key("_k", seed))
    keys = keys.withColumn("_b", F.substring("_h", 1, BUCKET_DIGITS))
    counts = keys.groupBy("_b").agg(F.count("*").alias("_n"))
    # At most 16**BUCKET_DIGITS rows in this window.
    running = W.orderBy("_b").rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    bucket = (
        counts.select(
            "_b", "_n",
            F.sum("_n").over(running).alias("_upto"),
            F.sum("_n").over(whole).alias("_total"),
        )
        .withColumn("_want", count.cast("long"))
        .filter("_want <= _upto and _want > _upto - _n")
        .select(F.col("_b").alias("_cb"), (F.col("_want") - F.col("_upto") + F.col("_n")).alias("_pos"))
    )
    inside = W.partitionBy("_b").orderBy("_h", "_k")
    return (
        keys.join(F.broadcast(bucket), F.col("_b") == F.col("_cb"))  # one row
        .withColumn("_rn", F.row_number().over(inside))
        .filter("_rn = _pos")
        .select(F.struct("_h", "_k").alias("cut"))
        .scalar()
    )


def up_to(key: str, seed: object, cut: Column) -> Column:
    """True for rows at or before a cut made by ``hash_cut``."""
    own = F.struct(hash_key(key, seed).alias("_h"), F.col(key).alias("_k"))
    return F.coalesce(own <= cut, F.lit(False))

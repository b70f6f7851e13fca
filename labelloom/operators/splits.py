"""Splits, folds, shards and mini-batches keyed on row ids."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.operators.epochs import epoch_ranks
from labelloom.operators.keyed import (
    hash_cut, hash_key, hash_rank, hash_threshold, key_rank, up_to,
)


def split_random(
    df: DataFrame, key: str, shares: Mapping[str, float], seed: object = 100, name: str = "split"
) -> DataFrame:
    """Independent draw per row with the given shares; no shuffle, no second pass.

    Rows without a key come first in hash order and so are in the first part.
    """
    parts = list(shares)
    total = float(sum(shares.values()))
    hashed = F.coalesce(hash_key(key, seed), F.lit("0" * 32))
    chosen: Column | None = None
    upto = 0.0
    for part in parts[:-1]:
        upto += shares[part] / total
        below = hashed < hash_threshold(upto)
        chosen = F.when(below, part) if chosen is None else chosen.when(below, part)
    last = F.lit(parts[-1])
    return df.withColumn(name, last if chosen is None else chosen.otherwise(last))


def split_exact_two(
    df: DataFrame, key: str, test_share: float = 0.25, seed: object = 0, name: str = "split"
) -> DataFrame:
    """Shuffled split with exactly ``ceil(n * test_share)`` test rows."""
    cut = hash_cut(df, key, seed, F.ceil(F.col("_total") * F.lit(float(test_share))))
    return df.withColumn(name, F.when(up_to(key, seed, cut), "test").otherwise("train"))


def split_exact_three(
    df: DataFrame, key: str, share: float = 0.1, seed: object = 0, name: str = "split"
) -> DataFrame:
    """``floor(n * share)`` rows each for test and validation, the rest for training."""
    size = F.floor(F.col("_total") * F.lit(float(share)))
    first = hash_cut(df, key, seed, size)
    second = hash_cut(df, key, seed, size * 2)
    return df.withColumn(
        name,
        F.when(up_to(key, seed, first), "test")
        .when(up_to(key, seed, second), "validation")
        .otherwise("train"),
    )


def tail_holdout(
    df: DataFrame, key: str, size: int = 1500, seed: object = 0,
    source: str = "test", target: str = "validation", name: str = "split",
) -> DataFrame:
    """Turn the last ``size`` rows of a split part, in hash order, into another part.

    Only the ``size`` last keys are ever ordered. A part of at most ``size`` rows moves
    as a whole.
    """
    last = (
        df.filter(F.col(name) == source)
        .select(F.struct(hash_key(key, seed).alias("_h"), F.col(key).alias("_k")).alias("cut"))
        .orderBy(F.desc("cut"))
        .limit(size)
        .agg(F.min("cut").alias("cut"))
        .scalar()
    )
    own = F.struct(hash_key(key, seed).alias("_h"), F.col(key).alias("_k"))
    moved = (F.col(name) == source) & F.coalesce(own >= last, F.lit(False))
    return df.withColumn(name, F.when(moved, target).otherwise(F.col(name)))


def fold_stratified(
    df: DataFrame, key: str, label: str, folds: int = 5, seed: object = 0, name: str = "fold"
) -> DataFrame:
    """Folds with equal class shares: per-class fold sizes differ by at most one."""
    ranked = hash_rank(df, key, seed, within=[label], name="_r")
    return ranked.withColumn(name, ((F.col("_r") - 1) % folds).cast("int")).drop("_r")


def fold_random(
    df: DataFrame, key: str, folds: int = 5, seed: object = 0, name: str = "fold"
) -> DataFrame:
    """Independent draw of a fold per row, from the first eight digits of the hash."""
    head = F.conv(F.substring(hash_key(key, seed), 1, 8), 16, 10).cast("long")
    return df.withColumn(name, (head % folds).cast("int"))


def shuffle_rows(df: DataFrame, key: str, seed: object = 0) -> DataFrame:
    """All rows in hash order."""
    return df.orderBy(hash_key(key, seed), key)


def _ranked(df: DataFrame, key: str, seed: object, shuffle: bool) -> DataFrame:
    if shuffle:
        return hash_rank(df, key, seed, name="_r")
    return key_rank(df, key, name="_r")


def shard_equal(
    df: DataFrame, key: str, shards: int, seed: object = 0, shuffle: bool = True,
    name: str = "shard",
) -> DataFrame:
    """Shards of exactly ``floor(n / shards)`` rows; left-over rows fill further shards.

    With fewer rows than shards all rows form one shard.
    """
    size = df.select(F.floor(F.count("*") / F.lit(shards)).alias("size")).scalar()
    ranked = _ranked(df, key, seed, shuffle)
    shard = F.when(size == 0, F.lit(0)).otherwise(F.floor((F.col("_r") - 1) / size))
    return ranked.withColumn(name, shard.cast("int")).drop("_r")


def _epochs(df: DataFrame, epochs: int) -> DataFrame:
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))


def batch_assign_all(
    df: DataFrame, key: str, batch_size: int, epochs: int, seed: object = 0, shuffle: bool = True
) -> DataFrame:
    """``(epoch, batch)`` per row and epoch, a fresh order each epoch, last batch kept."""
    if shuffle:
        # The epoch is part of the hashed key, so each epoch has its own order.
        ranked = epoch_ranks(df, key, epochs, seed, name="_r")
    else:
        ranked = _epochs(key_rank(df, key, name="_r"), epochs)
    return ranked.withColumn(
        "batch", F.floor((F.col("_r") - 1) / F.lit(batch_size)).cast("long")
    ).drop("_r")


def batch_assign_full(
    df: DataFrame, key: str, batch_size: int, epochs: int, seed: object = 0, shuffle: bool = True
) -> DataFrame:
    """The same without the last, incomplete batch of each epoch."""
    full = df.select(F.floor(F.count("*") / F.lit(batch_size)).alias("n")).scalar()
    return batch_assign_all(df, key, batch_size, epochs, seed, shuffle).filter(
        F.col("batch") < full
    )

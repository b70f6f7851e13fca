"""Weighted rendezvous hashing: rows to shards by a stable key.

Every shard draws a score from the record key and its own number; the highest score wins.
A shard's score does not depend on the other shards, so adding one moves only the rows that
the new shard wins, and removing one moves only its own rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelloom.plans.registry import query

# Hash buckets per shard in which slots are counted: 10**10 rows on 8 shards leave about
# 300,000 rows in a bucket.
SLOT_BUCKETS = 4096


def _uniform(key: Column, shard: Column, seed: int) -> Column:
    """A number in (0, 1) from the key and the shard number."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), key, shard), 12)
    return (bits.cast("double") + 0.5) / float(2**52)


def rendezvous(key: Column, weights: Sequence[float], seed: int = 7) -> Column:
    """Shard number 0, 1, ... of a key; a shard gets rows in proportion to its weight.

    A null key is a key like any other. Weights must be positive; the first shard wins a tie.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive, one for each shard")
    text = F.coalesce(key.cast("string"), F.lit("\x00null"))
    scores = F.transform(
        F.lit([float(w) for w in weights]),
        lambda w, i: F.struct((-w / F.ln(_uniform(text, i, seed))).alias("score"), (-i).alias("i")),
    )
    return (-F.array_max(scores)["i"]).cast("int")


def slots(rows: DataFrame, shard: str, order: Sequence[str], buckets: int = SLOT_BUCKETS) -> DataFrame:
    """Add ``slot``: 0, 1, ... without gaps in each shard, in hash order of ``order``.

    Rows are ranked in (shard, hash bucket) groups and shifted by the sizes of the shard's
    earlier buckets, so no shard goes through one task.
    """
    hashed = rows.withColumn("_h", F.xxhash64(*order)).withColumn("_b", F.pmod("_h", F.lit(buckets)))
    sizes = hashed.groupBy(shard, "_b").agg(F.count("*").alias("_n"))
    # At most ``buckets`` rows per shard.
    earlier = W.partitionBy(shard).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    before = sizes.select(shard, "_b", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = W.partitionBy(shard, "_b").orderBy("_h", *order)
    return (
        hashed.withColumn("_rank", F.row_number().over(inside))
        .join(before, [shard, "_b"])
        .withColumn("slot", (F.col("_rank") - 1 + F.col("_before")).cast("long"))
        .drop("_h", "_b", "_n", "_rank", "_before")
    )


def shard_rows(docs: DataFrame, key: str, weights: Sequence[float], seed: int = 7) -> DataFrame:
    """``docs`` with ``shard`` by :func:`rendezvous`; all columns stay, an own ``shard`` is replaced."""
    return docs.withColumn("shard", rendezvous(F.col(key), weights, seed))


@query("op6_rendezvous_shards")
def op6(spark, sf):
    """Documents in shards 0 to 7, and where each goes when there are 9."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = shard_rows(docs, "doc_id", [1.0] * 8).withColumn(
        "grown_shard", rendezvous(F.col("doc_id"), [1.0] * 9)
    )
    return slots(placed, "shard", ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )

"""Mixing sources to target weights with an exact splitting tree.

Each source is cut into blocks by a hash of the record key. The target size of a source
says how many of its blocks are drawn: whole passes over all blocks, then blocks of one
more pass up to the target, and the block that best fills the gap. A tree over the output shards splits these exact block
quotas: at each node the left half's share of every source is one draw from the
multivariate hypergeometric distribution, so quotas add up exactly at every level. A shard
then takes its own stretch of each source's permuted blocks, which no other shard shares,
and shuffles its rows by hash. The driver holds one number per source and shard.

Defined cases: a null source is a source of its own and comes last, a null key a key of its
own; rows that repeat a key stay together; rows of size 0 ride with their block; a source
without words is not taken; an empty table gives an empty result; other columns stay.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelloom.llm.common import words
from labelloom.plans.registry import query
from labelloom.storage import written

# A block is 1/4096 of a source: a source's taken size is off by half a block at most, and
# the block table has at most this many rows per source.
BLOCK_DIGITS = 3
# More blocks than the hypergeometric generator takes.
_LARGE = 999_000_000
# The table of drawn blocks is broadcast up to this many bytes.
TABLE_BYTES = 16_000_000
_ROW_BYTES = 120
# A source is repeated this often at most.
MAX_REPEATS = 3


def targets(sizes: DataFrame) -> DataFrame:
    """``(source, source_size, weight, target)`` from ``(source, source_size)``.

    Sources in code point order, null last, weigh 1, 2, 3, 1, ... and share the total size.
    A target stops at three times its source's size and the rest is shared again by weight.
    Sorted by the ratio of limit to weight, a source is at its limit exactly if its share of
    what the earlier ones leave is no less, so one pass settles all rounds of resharing.
    One row per source goes through one task.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    by_room = W.orderBy(
        F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()
    )
    earlier = by_room.rowsBetween(W.unboundedPreceding, -1)
    later = by_room.rowsBetween(W.currentRow, W.unboundedFollowing)
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    limited = (
        sizes.withColumn("weight", (F.row_number().over(by_name) - 1) % 3 + 1)
        .withColumn("_limit", F.col("source_size") * MAX_REPEATS)
        .withColumn("_order", F.row_number().over(by_room))
        .withColumn("_left", F.sum("source_size").over(whole) - F.coalesce(F.sum("_limit").over(earlier), F.lit(0)))
        .withColumn("_weights", F.sum("weight").over(later))
        .withColumn("_full", F.col("_limit") * F.col("_weights") <= F.col("_left") * F.col("weight"))
    )
    first = F.min(F.when(~F.col("_full"), F.struct("_order", "_left", "_weights"))).over(whole)
    return limited.withColumn("_first", first).select(
        "source", "source_size", "weight",
        F.when(F.col("_full"), F.col("_limit").cast("double"))
        .otherwise((F.col("weight") * F.col("_first._left")) / F.col("_first._weights"))
        .alias("target"),
    )


def split_quotas(quotas: list[int], shards: int, seed: int) -> list[list[int]]:
    """Quota of every source in every shard; rows add up to ``quotas``.

    Shards get equal shares of all blocks, one more or less. The work is one vector of
    sources per shard, whatever the size of the data.
    """
    out: list[list[int]] = [[0] * shards for _ in quotas]

    def descend(have: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            for s, n in enumerate(have):
                out[s][lo] = int(n)
            return
        mid, total = (lo + hi) // 2, int(have.sum())
        rng = np.random.default_rng([seed, lo, hi])
        n_left = total * (mid - lo) // (hi - lo)
        left = np.zeros_like(have)
        rest, room = total, n_left
        # Source by source: each takes a hypergeometric share of what is left of the draw.
        for s, n in enumerate(have):
            rest -= int(n)
            if room and n:
                # Beyond the library's range a draw of so few is binomial.
                draw = rng.binomial(int(n), room / (rest + int(n))) if rest >= _LARGE else rng.hypergeometric(int(n), rest, room)
                left[s] = min(max(int(draw), room - rest), room)
            room -= int(left[s])
        descend(left, lo, mid)
        descend(have - left, mid, hi)

    descend(np.array(quotas, dtype=np.int64), 0, shards)
    return out


def assign(docs: DataFrame, key: str, shards: int, seed: int = 11) -> DataFrame:
    """Add ``source_size``, ``target`` and ``draws`` to rows with ``source`` and ``size``.

    ``draws`` has one ``(pass, shard)`` per time that the row is taken: none to three.
    Rows with the same key stay together. A null source is a source of its own, a null key
    a key of its own; size 0 rows ride with their block.
    """
    spark = docs.sparkSession
    hashed = docs.withColumn("_source", F.coalesce(F.concat(F.lit("="), "source"), F.lit("-"))).withColumn(
        "_block",
        F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary")), 1, BLOCK_DIGITS),
    )
    blocks = hashed.groupBy("_source", "source", "_block").agg(F.sum("size").alias("_words"))
    sizes = blocks.groupBy("source").agg(F.sum("_words").alias("source_size"))
    goal = targets(sizes).select(
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")).alias("_source"), "source_size", "target"
    )
    upto = W.partitionBy("_source").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("_source")
    # At most 4096 blocks per source.
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    drawn = (
        blocks.join(F.broadcast(goal), "_source")  # one row per source, see targets()
        .withColumn("_before", F.coalesce(F.sum("_words").over(upto), F.lit(0)))
        .withColumn("_passes", passes)
        .withColumn("_rest", F.col("target") - F.col("_passes") * F.col("source_size"))
        .withColumn("_in", (F.col("_words") > 0) & (F.col("_before") + F.col("_words") <= F.col("_rest")))
        .withColumn("_gap", F.col("_rest") - F.coalesce(F.sum(F.when(F.col("_in"), F.col("_words"))).over(whole), F.lit(0)))
        # One more block where its size brings the source nearer to its target.
        .withColumn("_miss", F.when(~F.col("_in") & (F.col("_words") > 0), F.abs(F.col("_words") - F.col("_gap"))))
        .withColumn("_fill", F.min(F.when(F.col("_miss") < F.col("_gap"), F.struct("_miss", "_block"))).over(whole))
        .withColumn("_n", F.col("_passes") + (F.col("_in") | F.coalesce(F.col("_fill._block") == F.col("_block"), F.lit(False))).cast("int"))
    )
    per_source = drawn.groupBy("_source").agg(F.sum("_n").alias("n")).orderBy("_source").collect()
    quotas = split_quotas([int(r["n"]) for r in per_source], shards, seed)
    ends = [{"s": r["_source"], "e": np.cumsum(q).tolist()} for r, q in zip(per_source, quotas, strict=True)]
    # The driver's few numbers go back as one literal.
    tree = spark.range(1).select(
        F.explode(F.from_json(F.lit(json.dumps(ends)), "array<struct<s string, e array<bigint>>>")).alias("x")
    ).select(F.col("x.s").alias("_source"), F.col("x.e").alias("_ends"))
    # Blocks of a source in permuted order, pass by pass: at most 3 * 4096 rows a source.
    permuted = W.partitionBy("_source").orderBy("_pass", F.xxhash64(F.lit(seed), "_pass", "_block"), "_block")
    placed = (
        drawn.filter("_n > 0")
        .select("_source", "_block", F.explode(F.sequence(F.lit(1), "_n")).alias("_pass"))
        .withColumn("_rank", F.row_number().over(permuted))
        .join(F.broadcast(tree), "_source")  # one row per source
        .withColumn("_shard", F.size(F.filter("_ends", lambda e: e < F.col("_rank"))))
        .groupBy("_source", "_block")
        .agg(F.sort_array(F.collect_list(F.struct(F.col("_pass").alias("pass"), F.col("_shard").alias("shard")))).alias("draws"))
    )
    table = written(
        drawn.select("_source", "_block", "source_size", "target").join(placed, ["_source", "_block"], "left"), "drawn-blocks"
    )
    bytes_ = table.agg(F.sum(F.octet_length("_source") + _ROW_BYTES).alias("b")).first()["b"] or 0
    if bytes_ <= TABLE_BYTES:  # rows then stay where they are
        table = F.broadcast(table)
    empty = F.lit([]).cast("array<struct<pass:int,shard:int>>")
    return (
        hashed.join(table, ["_source", "_block"])
        .withColumn("draws", F.coalesce("draws", empty))
        .drop("_source", "_block")
    )


def mix(docs: DataFrame, key: str, shards: int, seed: int = 11) -> DataFrame:
    """The mixed rows: every row once per draw, with ``pass``, ``shard`` and ``order``.

    ``order`` is the row's place in its shard's local shuffle. Rows of a shard are together
    and in that order, so written files hold whole stretches of the mix.
    """
    return (
        assign(docs, key, shards, seed)
        .select("*", F.explode("draws").alias("_d"))
        .select("*", F.col("_d.pass").alias("pass"), F.col("_d.shard").alias("shard"))
        .withColumn("order", F.xxhash64(F.lit(seed), "pass", F.col(key)))
        .drop("_d", "draws")
        .repartition(shards, "shard")
        .sortWithinPartitions("shard", "order")
    )


def word_count(text: str = "text"):
    return F.size(words(F.col(text))).cast("long")


@query("op5_mix_sources")
def op5(spark, sf):
    """Words that a mix of all documents takes of each."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", word_count().alias("size"))
    return assign(docs, "doc_id", shards=64).select(
        "doc_id", "size", "source_size", "target",
        (F.col("size") * F.size("draws")).cast("long").alias("taken"),
        F.array_join(F.transform("draws", lambda d: d["shard"].cast("string")), ",").alias("shards"),
    )

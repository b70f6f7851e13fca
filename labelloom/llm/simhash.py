"""SimHash fingerprints and near-duplicate groups by multi-index hashing.

A fingerprint has 64 bits; two documents are linked if theirs differ in at most two. Cut
into two halves, such fingerprints agree in one half up to a single bit. So each
fingerprint is entered in a table under either half, and asks in it for the 33 values
within one bit of either half. A key that finds nothing is dropped at once.

Complete distances are verified without forming pairs: under a key, an entry (half equal to
the key) reaches all values within one bit of its other half, a request (half one bit off)
only its own. Those that meet at a value are within two bits of one another, and any two
fingerprints within two bits meet somewhere. At most 65 fingerprints can meet at one value,
so a star per value holds every link, however dense a group of copies is.

Defined cases: a null or empty text, or one without words, has fingerprint zero and is
linked like any other; rows without a key get the component of their fingerprint, or null;
rows that repeat a key have the component of their own text each, so that a key with different
texts may stand in several groups; columns other than key and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import ship
from labelloom.llm.components import components
from labelloom.plans.registry import query
from labelloom.storage import written

SHINGLE = 3
SEED = 42
# Shingles whose bits are counted at a time.
_CHUNK = 65_536
# Fingerprints shared by at least this part of all rows, at most as many, are looked up
# from a broadcast table.
_HOT = 1024


def simhash(text: bytes | None, shingle: int = SHINGLE) -> int:
    """64-bit fingerprint of the lower-cased words of a text."""
    from xxhash import xxh64_intdigest

    # For bytes, lower() changes A-Z and split() cuts at the six white-space bytes only.
    tokens = (text or b"").lower().split()
    if not tokens:
        return 0
    if len(tokens) < shingle:
        grams, n = iter([tokens]), 1
    else:
        grams, n = zip(*[tokens[k:] for k in range(shingle)]), len(tokens) - shingle + 1
    hashes = np.fromiter(map(xxh64_intdigest, map(b" ".join, grams), repeat(SEED)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        bits = hashes[at : at + _CHUNK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(bits, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = np.array([simhash(t, shingle) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["key", "fp"])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(key, fp)`` of every row."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(lambda batches: _fingerprints(batches, shingle), f"key {kind}, fp bigint")


def links(fps: DataFrame) -> DataFrame:
    """Stars ``(a, b)`` that connect the keys of ``(fp, key)`` within two bits."""
    low, high = F.col("fp").bitwiseAND(2**32 - 1), F.shiftrightunsigned("fp", 32)
    masks = [0] + [1 << k for k in range(32)]
    tables = [(0, m) for m in masks] + [(1, m) for m in masks]
    probes = fps.select(
        "fp", "key",
        F.explode(F.array(*[F.struct(F.lit(s).alias("s"), F.lit(m).cast("long").alias("m")) for s, m in tables])).alias("t"),
    ).select(
        "fp", "key",
        # Table number above the half that is asked for.
        F.when(F.col("t.s") == 0, low.bitwiseXOR(F.col("t.m"))).otherwise(high.bitwiseXOR(F.col("t.m")) + 2**32).alias("slot"),
    ).repartition("slot")
    second = F.col("slot") >= 2**32
    entered = F.when(second, high + 2**32).otherwise(low) == F.col("slot")
    found = (
        probes.groupBy("slot").agg(F.count("*").alias("n"), F.max(entered).alias("entered"))
        .filter("n > 1 and entered").select("slot")
    )
    other = F.when(second, low).otherwise(high)
    reach = F.when(entered, F.transform(F.lit(masks).cast("array<bigint>"), lambda m: other.bitwiseXOR(m))).otherwise(F.array(other))
    return (
        probes.join(found, "slot")
        .select("slot", "fp", "key", F.explode(reach).alias("value"))
        .groupBy("slot", "value")
        .agg(F.collect_set(F.struct("key", "fp")).alias("met"))  # 65 at most
        .filter(F.size("met") > 1)
        .select(F.array_min("met").alias("hub"), F.explode("met").alias("x"))
        .filter(F.expr("x.key <> hub.key and bit_count(x.fp ^ hub.fp) <= 2"))
        .select(F.col("x.key").alias("a"), F.col("hub.key").alias("b"))
        .distinct()
    )


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(key, fp, component)`` of every row; the component is the least key reachable."""
    marked = written(fingerprints(docs, key, text, shingle), "fingerprints")
    # Copies fall together before anything moves.
    fps = written(marked.groupBy("fp").agg(F.min("key").alias("key"), F.count("*").alias("n")), "distinct-fingerprints")
    roots = components(links(fps.select("fp", "key").filter("key is not null")))
    named = written(
        fps.join(roots, fps["key"] == roots["node"], "left")
        .select("fp", "n", F.coalesce("root", "key").alias("component")),
        "named-fingerprints",
    )
    total = F.lit(marked.count())
    hot = F.col("n") * _HOT >= total
    often = F.broadcast(named.filter(hot).select("fp", F.col("component").alias("_often")))
    rest = named.filter(~hot).select(F.col("fp").alias("_fp"), F.col("component").alias("_rest"))
    first = marked.join(often, "fp", "left")
    # Rows that are answered already are spread by a key of their own.
    ask = F.when(F.col("_often").isNull(), F.col("fp"))
    known = first.filter(F.col("_often").isNotNull()).select("key", "fp", F.col("_often").alias("component"))
    asked = (
        first.filter(F.col("_often").isNull()).withColumn("_ask", ask)
        .join(rest, F.col("_ask") == F.col("_fp"), "left")
        .select("key", "fp", F.col("_rest").alias("component"))
    )
    return known.union(asked)


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row of each group of ``near_duplicates``: the one with the least key. All columns stay.

    Of rows that repeat a key one stays; rows without a key cannot be named and all stay.
    """
    groups = near_duplicates(docs, key, text, shingle)
    stay = written(
        groups.groupBy("key", "component").agg(F.count("*").alias("n"))
        .filter(F.col("key") == F.col("component")).select(F.col("key").alias("_key"), "n"),
        "stay",
    )
    columns = docs.columns
    # One way at every size: rows meet their key, which alone is held by a task.
    kept = docs.join(stay.select("_key", F.col("n").alias("_n")).hint("shuffle_hash"), F.col(key) == F.col("_key"))
    once = kept.filter("_n = 1").select(*columns)
    repeated = kept.filter("_n > 1").dropDuplicates([key]).select(*columns)
    return once.union(repeated).union(docs.filter(F.col(key).isNull()))


@query("op1_simhash_groups")
def op1(spark, sf):
    """Fingerprint and near-duplicate component of every document."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select(
        F.col("key").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )

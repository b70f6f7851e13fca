"""Joining many rows with a dictionary-like table whose keys may be very unequal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.storage import written

# A dictionary of at most this many bytes is broadcast whole.
BROADCAST_BYTES = 32_000_000
# Otherwise only keys that hold at least 1/HOT_KEYS of all uses are; there cannot be more
# than HOT_KEYS of them.
HOT_KEYS = 1024


def row_bytes(df: DataFrame) -> Column:
    """Bytes of a row's values, about as Spark holds them: eight a column and what varies."""

    def size(value: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.octet_length(value)
        if isinstance(kind, T.ArrayType):
            inner = kind.elementType
            if isinstance(inner, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)):
                return F.aggregate(value, F.lit(0).cast("long"), lambda a, x: a + 8 + F.coalesce(size(x, inner), F.lit(0)))
            return F.size(value) * 8
        if isinstance(kind, T.MapType):
            return size(F.map_keys(value), T.ArrayType(kind.keyType)) + size(F.map_values(value), T.ArrayType(kind.valueType))
        if isinstance(kind, T.StructType):
            total = F.lit(8 * len(kind.fields))
            for f in kind.fields:
                total = total + F.coalesce(size(value[f.name], f.dataType), F.lit(0))
            return total
        return F.lit(0)

    total = F.lit(8 * (len(df.columns) + 1)).cast("long")
    for field in df.schema.fields:
        total = total + F.coalesce(size(F.col(field.name), field.dataType), F.lit(0))
    return total


def fits_broadcast(table: DataFrame, limit: int | None = None) -> bool:
    """Whether the rows of a written table have at most ``limit`` bytes; reads it once."""
    held = table.agg(F.sum(row_bytes(table)).alias("b")).first()["b"] or 0
    return held <= (BROADCAST_BYTES if limit is None else limit)


def lookup(
    facts: DataFrame,
    table: DataFrame,
    on: str,
    spread: str,
    weight: str | None = None,
    how: str = "inner",
    broadcast_bytes: int | None = None,
) -> DataFrame:
    """Join ``facts`` with ``table`` (unique ``on``), whatever the size and skew.

    ``table`` should be a written table: its bytes are added up first. A small one is
    broadcast. Of a large one only the hot keys are broadcast, and the rest is a shuffled
    join in which the rows already answered are spread over all tasks by ``spread`` instead
    of meeting at the hot key. Which keys are hot is read from ``weight``, the column that
    says how often a key is used; without it the uses are counted first.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be 'inner' or 'left'")
    if fits_broadcast(table, broadcast_bytes):
        return facts.join(F.broadcast(table), on, how)

    payload = [c for c in table.columns if c != on]
    entry = F.struct(*payload)
    if weight is None:
        uses = written(facts.groupBy(on).agg(F.count("*").alias("_uses")), "uses")
        total = uses.agg(F.sum("_uses").alias("total")).scalar()
        hot_keys = uses.filter(F.col("_uses") * F.lit(HOT_KEYS) >= total).select(on)
        hot = table.join(F.broadcast(hot_keys), on).select(on, entry.alias("_hot"))
    else:
        total = table.agg(F.sum(weight).alias("total")).scalar()
        hot = table.filter(F.col(weight) * F.lit(HOT_KEYS) >= total).select(
            on, entry.alias("_hot")
        )

    kind = table.schema[on].dataType

    def bucket(name: str, same: bool = True):
        # Both sides hash the key as one type: an int and an equal long hash differently.
        column = F.col(name).cast(kind) if same else F.col(name)
        return F.pmod(F.xxhash64(column), F.lit(4096))

    # Settled rows get a bucket beyond those of the table, taken from ``spread``: they match
    # nothing and go to all tasks. (A constant salt would be folded away by the optimizer.)
    settled = F.col("_hot").isNotNull() | F.col(on).isNull()
    answered = facts.join(F.broadcast(hot), on, "left").withColumn(
        "_bucket", F.when(settled, bucket(spread, False) + 4096).otherwise(bucket(on))
    )
    cold = table.select(F.col(on).alias("_on"), bucket(on).alias("_b"), entry.alias("_cold"))
    joined = answered.join(
        cold, (answered[on] == cold["_on"]) & (answered["_bucket"] == cold["_b"]), "left"
    ).withColumn("_entry", F.coalesce("_hot", "_cold"))
    if how == "inner":
        joined = joined.filter(F.col("_entry").isNotNull())
    return joined.select(
        on,
        *[c for c in facts.columns if c != on],
        *[F.col(f"_entry.{c}").alias(c) for c in payload],
    )

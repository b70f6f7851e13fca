import pytest
from pyspark.sql import functions as F

from labelloom.operators import lookup as lookup_module
from labelloom.operators.lookup import fits_broadcast, lookup, row_bytes


@pytest.fixture(scope="module")
def facts(spark):
    # A third of the rows use one key, some use unknown keys, some have none.
    key = (
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 11 == 0, F.lit(None))
        .otherwise(F.concat(F.lit("k"), (F.col("id") % 5000).cast("string")))
    )
    return spark.range(20000).withColumn("word", key).cache()


@pytest.fixture(scope="module")
def table(spark, facts):
    uses = facts.filter("word is not null").groupBy("word").count()
    return uses.filter("word <> 'k7'").select(
        "word", F.col("count").alias("uses"), F.md5("word").alias("value")
    ).cache()


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("weight", ["uses", None])
@pytest.mark.parametrize("limit", [0, 10**6])
def test_lookup_equals_plain_join(facts, table, how, weight, limit):
    got = lookup(facts, table, "word", "id", weight, how, broadcast_bytes=limit)
    want = facts.join(table, "word", how).select(*got.columns)
    assert got.exceptAll(want).count() == 0
    assert got.count() == want.count()


def test_hot_rows_do_not_meet_in_one_task(spark, facts, table):
    saved = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = lookup(facts, table, "word", "id", "uses", "left", broadcast_bytes=0)
        sizes = joined.groupBy(F.spark_partition_id()).count().collect()
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)
    assert len(sizes) == 8
    assert max(r["count"] for r in sizes) < 2 * 20000 / 8


def test_few_wide_rows_are_not_broadcast(spark):
    table = spark.range(200).select("id", F.array_repeat(F.lit(0.5), 5000).alias("v"), F.lit("é" * 10).alias("s"))
    size = table.agg(F.sum(row_bytes(table))).first()[0]
    assert 200 * (8 * 5000 + 20) <= size <= 200 * (8 * 5000 + 100)
    assert fits_broadcast(table, 9_000_000) and not fits_broadcast(table, 7_000_000)
    nested = spark.range(3).select(F.create_map(F.lit("k"), F.struct(F.lit("abc").alias("x"))).alias("m"), F.lit(None).cast("string").alias("z"))
    assert nested.agg(F.sum(row_bytes(nested))).first()[0] > 3 * 16
    assert fits_broadcast(table.limit(0), 0)


def test_wide_table_goes_through_the_shuffled_join(spark, facts, table, monkeypatch):
    monkeypatch.setattr(lookup_module, "BROADCAST_BYTES", 1000)
    wide = table.withColumn("wide", F.array_repeat("uses", 50))
    got = lookup(facts, wide, "word", "id", "uses", "left")
    want = facts.join(wide, "word", "left").select(*got.columns)
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()

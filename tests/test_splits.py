import hashlib
import math

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelloom.operators import epochs, keyed, splits


def ids(spark, n):
    return spark.range(n)


def keyed_hash(column):
    return keyed.hash_key(column, 3)


def md5(seed, key):
    return hashlib.md5(f"{seed}:{key}".encode()).hexdigest()


@pytest.mark.parametrize("digits", [1, 3, 4])
def test_hash_rank_equals_one_task_window(spark, digits):
    # A third of all rows share one group; another group is NULL.
    df = spark.range(3000).withColumn(
        "g", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 != 0, (F.col("id") % 50).cast("string"))
    )
    got = keyed.hash_rank(df, "id", 5, within=["g"], name="r", digits=digits)
    want = df.withColumn(
        "r",
        F.row_number().over(W.partitionBy("g").orderBy(keyed.hash_key("id", 5), "id")).cast("long"),
    )
    assert got.exceptAll(want).count() == 0 and got.count() == 3000


def test_key_rank_equals_one_task_window(spark):
    df = spark.range(2000).withColumn("k", F.col("id") * F.col("id") - 500)
    got = keyed.key_rank(df, "k", name="r")
    want = df.withColumn("r", F.row_number().over(W.orderBy("k")).cast("long"))
    assert got.exceptAll(want).count() == 0 and got.count() == 2000


@pytest.mark.parametrize("n", [1, 9, 10, 11, 1500, 1501])
def test_exact_split_sizes(spark, n):
    three = splits.split_exact_three(ids(spark, n), "id").groupBy("split").count()
    sizes = {r["split"]: r["count"] for r in three.collect()}
    tenth = int(n * 0.1)
    assert sizes.get("test", 0) == sizes.get("validation", 0) == tenth
    assert sizes["train"] == n - 2 * tenth
    two = splits.split_exact_two(ids(spark, n), "id", 0.25).filter("split = 'test'")
    order = sorted(range(n), key=lambda i: md5(0, i))
    assert {r["id"] for r in two.collect()} == set(order[: math.ceil(n * 0.25)])


@pytest.mark.parametrize("n", [1500, 1501, 1700])
def test_holdout_takes_the_last_rows_of_the_part(spark, n):
    rows = ids(spark, n).withColumn("split", F.lit("test"))
    out = splits.tail_holdout(rows, "id").groupBy("split").count().collect()
    sizes = {r["split"]: r["count"] for r in out}
    assert sizes["validation"] == 1500 and sizes.get("test", 0) == n - 1500


def test_holdout_leaves_other_parts_alone(spark):
    rows = ids(spark, 30).withColumn("split", F.when(F.col("id") < 20, "train").otherwise("test"))
    sizes = {r[0]: r[1] for r in splits.tail_holdout(rows, "id", 4).groupBy("split").count().collect()}
    assert sizes == {"train": 20, "test": 6, "validation": 4}


def test_random_split_is_stable_under_repartitioning(spark):
    shares = {"a": 0.5, "b": 0.2, "c": 0.3}
    one = splits.split_random(ids(spark, 5000).repartition(3), "id", shares)
    two = splits.split_random(ids(spark, 5000).repartition(11), "id", shares)
    assert one.exceptAll(two).count() == 0
    sizes = {r[0]: r[1] for r in one.groupBy("split").count().collect()}
    assert sum(sizes.values()) == 5000
    assert all(abs(sizes[k] / 5000 - v) < 0.03 for k, v in shares.items())


def test_exact_split_moves_no_rows(spark):
    plan = splits.split_exact_two(ids(spark, 100), "id")._jdf.queryExecution().executedPlan()
    outer = plan.toString().split("Subquery")[0]
    assert "Exchange" not in outer


def test_stratified_folds_have_equal_class_shares(spark):
    df = ids(spark, 1003).withColumn("label", F.when(F.col("id") % 3 == 0, "hot").otherwise("x"))
    sizes = splits.fold_stratified(df, "id", "label").groupBy("label", "fold").count()
    for label in ("hot", "x"):
        counts = [r["count"] for r in sizes.filter(F.col("label") == label).collect()]
        assert len(counts) == 5 and max(counts) - min(counts) <= 1


@pytest.mark.parametrize(
    "n, shards, sizes", [(5, 3, [1, 1, 1, 1, 1]), (2, 3, [2]), (9, 3, [3, 3, 3])]
)
@pytest.mark.parametrize("shuffle", [True, False])
def test_shard_sizes(spark, n, shards, sizes, shuffle):
    out = splits.shard_equal(ids(spark, n), "id", shards, shuffle=shuffle).groupBy("shard").count()
    assert [r["count"] for r in out.orderBy("shard").collect()] == sizes


def test_batches_cover_every_epoch_and_reshuffle(spark):
    out = splits.batch_assign_all(ids(spark, 25), "id", 10, 2).collect()
    per_epoch = {e: {r["id"]: r["batch"] for r in out if r["epoch"] == e} for e in (0, 1)}
    for batches in per_epoch.values():
        assert sorted(batches) == list(range(25))
        assert sorted(batches.values()).count(2) == 5
    assert per_epoch[0] != per_epoch[1]
    full = splits.batch_assign_full(ids(spark, 25), "id", 10, 2)
    assert full.count() == 40
    plain = splits.batch_assign_all(ids(spark, 25), "id", 10, 1, shuffle=False).collect()
    assert all(r["batch"] == r["id"] // 10 for r in plain)


def test_shuffle_is_a_reproducible_permutation(spark):
    one = [r["id"] for r in splits.shuffle_rows(ids(spark, 50), "id", 3).collect()]
    assert one == sorted(range(50), key=lambda i: md5(3, i))
    assert one != [r["id"] for r in splits.shuffle_rows(ids(spark, 50), "id", 4).collect()]


def test_rows_without_a_key_keep_a_place(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (None, "a")], "id long, label string")
    assert splits.fold_stratified(df, "id", "label", 2).count() == 3
    assert splits.shard_equal(df, "id", 2).count() == 3


def test_rows_without_a_key_are_in_the_first_part(spark):
    rows = spark.createDataFrame([(1,), (None,), (2,)], "k long")
    got = splits.split_random(rows, "k", {"train": 0.5, "test": 0.5}).filter("k is null").first()
    assert got["split"] == "train"


def test_offsets_of_many_groups_are_not_broadcast(spark):
    out = splits.batch_assign_all(ids(spark, 500), "id", 64, 20)
    assert len(out.collect()) == 500 * 20
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", ["id", "cast(id as string)", "concat('key with many letters, more than a block of md5 takes ', id)"])
def test_epochs_equal_one_task_windows(spark, monkeypatch, key):
    monkeypatch.setattr(epochs, "RANGE_ROWS", 100)
    monkeypatch.setattr(epochs, "LIST_ROWS", 70)
    df = spark.range(-300, 900).selectExpr(f"{key} as k", "id as other")
    df = df.withColumn("k", F.when(F.col("other") != 5, F.col("k")))
    keyed = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(11)))).withColumn("_k", F.concat_ws(":", "epoch", "k"))
    order = W.partitionBy("epoch").orderBy(keyed_hash("_k"), "_k")
    want = keyed.withColumn("batch", F.floor((F.row_number().over(order) - 1) / 7).cast("long")).drop("_k")
    got = splits.batch_assign_all(df, "k", 7, 12, seed=3)
    assert got.columns == want.columns and got.count() == 14400 and got.exceptAll(want).count() == 0


def test_epochs_take_few_bytes_a_row(spark, tmp_path, monkeypatch):
    sizes = []
    monkeypatch.setattr(epochs, "written", lambda df, name: sizes.append(name) or keep(df, str(tmp_path / name)))

    def keep(df, path):
        df.write.parquet(path)
        return df.sparkSession.read.parquet(path)

    out = splits.batch_assign_all(ids(spark, 200_000), "id", 64, 10)
    assert out.count() == 2_000_000 and sizes == ["epoch-rows"]
    held = sum(f.stat().st_size for f in (tmp_path / "epoch-rows").glob("*.parquet"))
    assert held < 2 * 2_000_000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Window [row_number" not in plan


def test_full_batches_are_those_of_all(spark, monkeypatch):
    monkeypatch.setattr(epochs, "RANGE_ROWS", 50)
    df = ids(spark, 330)
    every = splits.batch_assign_all(df, "id", 32, 3)
    full = splits.batch_assign_full(df, "id", 32, 3)
    assert full.count() == 3 * 320 and full.exceptAll(every.filter("batch < 10")).count() == 0
    plan = full._jdf.queryExecution().executedPlan().toString()
    assert "Window [row_number" not in plan and "Generate" not in plan

"""Writers and the readers that undo them."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# How often models are saved and how many are kept.
CHECKPOINT_EVERY = 100
NUM_CHECKPOINTS = 5


def write_csv(df: DataFrame, path: str, rows_per_file: int = 100_000) -> None:
    """Headered CSV that ``read_labelled_csv`` restores unchanged.

    Files are bounded, since one with line breaks in fields is read by a single task.
    """
    df.write.options(
        header=True, quote='"', escape='"', quoteAll=True, maxRecordsPerFile=rows_per_file,
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).csv(path)


def write_labelled_files(df: DataFrame, path: str, root: str, folder: str, text: str = "text") -> None:
    """One text file per row in the folder ``root=.../folder=...`` of its values.

    Tasks move their own files into place: on the driver, that takes longer than writing them.
    A file takes as long whatever its size, so rows are dealt to all cores by their folder.
    """
    tasks = 4 * df.sparkSession.sparkContext.defaultParallelism
    df.select(root, folder, text).repartition(tasks, root, folder).write.options(
        maxRecordsPerFile=1, **{"mapreduce.fileoutputcommitter.algorithm.version": 2}
    ).partitionBy(root, folder).text(path)


def write_vocabulary(
    path: str, vocabulary: DataFrame, vectors: DataFrame, unknown: DataFrame
) -> None:
    """Words with ids, word vectors and unknown words as three tables."""
    vocabulary.write.mode("overwrite").parquet(f"{path}/vocabulary")
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    unknown.write.mode("overwrite").parquet(f"{path}/unknown")


def read_vocabulary(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(
        spark.read.parquet(f"{path}/{part}") for part in ("vocabulary", "vectors", "unknown")
    )


def write_split(df: DataFrame, path: str, split: str = "split") -> None:
    """One folder per split part, so a reader of one part opens only its files."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def read_split(spark: SparkSession, path: str, part: str, split: str = "split") -> DataFrame:
    return spark.read.parquet(path).filter(F.col(split) == part).drop(split)


def append_metrics(metrics: DataFrame, path: str, run_id: str) -> None:
    """Append ``(step, series, loss, accuracy)`` rows of a run."""
    metrics.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy(
        "run_id", "series"
    ).parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_model(
    spark: SparkSession, model: PipelineModel, run: str, step: int,
    every: int = CHECKPOINT_EVERY, keep: int = NUM_CHECKPOINTS,
) -> None:
    """Save a model for a step; the newest ``keep`` saves of a run survive.

    Saves go round ``keep`` folders, so the oldest is overwritten and nothing has to be
    deleted. The step is listed only after its model is complete.
    """
    slot = (step // every) % keep
    model.write().overwrite().save(f"{run}/slot-{slot}")
    spark.createDataFrame([(step, slot)], "step long, slot int").coalesce(1).write.mode(
        "append"
    ).parquet(f"{run}/steps")


def saved_steps(spark: SparkSession, run: str) -> DataFrame:
    """``(step, slot)`` of the models that can be restored, newest first."""
    return (
        spark.read.schema("step long, slot int").parquet(f"{run}/steps")
        .groupBy("slot").agg(F.max("step").alias("step"))
        .select("step", "slot").orderBy(F.desc("step"))
    )


def load_latest(spark: SparkSession, run: str) -> tuple[int, PipelineModel]:
    newest = saved_steps(spark, run).first()
    return newest["step"], PipelineModel.load(f"{run}/slot-{newest['slot']}")


def preview(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The first ``n`` rows in key order; reads top-n per task, no full sort."""
    return df.orderBy(key).limit(n)


def schema_table(df: DataFrame) -> list[tuple[str, str]]:
    """Column names and types."""
    return df.dtypes

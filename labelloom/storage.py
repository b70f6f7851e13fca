"""Where intermediate tables live.

Anything that has to be durable (fitted vocabularies, model directories, cut lineage) goes
to the folder the cluster names in ``spark.checkpoint.dir``. Only a local-mode session
without that setting gets a folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_DIR = "spark.checkpoint.dir"
_own_dirs: dict[str, str] = {}
_run: ContextVar[str | None] = ContextVar("run", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the session."""
    named = spark.conf.get(_DIR, None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError(f"set {_DIR} to a folder that every executor can reach")
    if context.applicationId not in _own_dirs:
        _own_dirs[context.applicationId] = tempfile.mkdtemp(prefix="labelloom-")
    return _own_dirs[context.applicationId]


def new_path(spark: SparkSession, name: str, lasting: bool = False) -> str:
    """A path below the shared folder that nobody has used yet, in the open run's folder if any.

    ``lasting`` files stay when a run's folder is dropped.
    """
    folder = None if lasting else _run.get()
    return f"{folder or shared_dir(spark) + '/labelloom'}/{name}-{uuid.uuid4().hex}"


@contextmanager
def run_folder(spark: SparkSession, name: str) -> Iterator[str]:
    """A folder of its own for all tables that are written inside the block."""
    folder = new_path(spark, name)
    token = _run.set(folder)
    try:
        yield folder
    finally:
        _run.reset(token)


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Delete a run's folder; tables in it must not be read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` once and go on from the files.

    Used for fitted tables that are read more than once: later plans neither recompute
    them nor depend on executors that may be gone, and Spark knows their true size.
    ``options`` go to the writer.
    """
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.parquet(path)


@contextmanager
def setting(spark: SparkSession, name: str, value: object) -> Iterator[None]:
    """A setting of the session that holds for what runs inside the block."""
    before = spark.conf.get(name)
    spark.conf.set(name, str(value))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """At most so many rows go to Python at a time in what runs inside the block."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(name))
    with setting(spark, name, min(rows, before) if before > 0 else rows):
        yield


def spread(df: DataFrame, key: str) -> DataFrame:
    """Place rows by ``key`` in as many partitions as the session asks for.

    A file of one row group arrives in one task. A session on such small files may set
    ``labelloom.scan.partitions``; without it the scan stays as it is.
    """
    wanted = df.sparkSession.conf.get("labelloom.scan.partitions", None)
    return df.repartition(int(wanted), key) if wanted else df

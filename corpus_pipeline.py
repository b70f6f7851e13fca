"""A corpus from raw documents to tokens, stage by stage.

Every stage takes the documents that the stage before it wrote and returns documents again,
with all their columns; the last one returns tokens. Names of extra columns do not matter.
What a stage keeps in between lies in a folder of its own in the shared folder, which the next
stage drops: by then the stage's result has been written.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.llm import bpe, mixing, quality, repeats, simhash
from labelloom.plans.registry import query
from labelloom.storage import drop_folder, run_folder, written

# The mix goes to shards of about so many bytes of text, and to so many at least.
SHARD_BYTES, LEAST_SHARDS = 128_000_000, 64
# Words that a worker remembers while it encodes: it holds memory while later stages or runs go on.
WORDS = 50_000
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_finished: dict[str, list[str]] = {}


def _stage(make: Stage) -> Stage:
    """Give a stage a folder for its tables, and drop those of the stages before it."""

    @wraps(make)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        earlier = _finished.setdefault(spark.sparkContext.applicationId, [])
        while earlier:
            drop_folder(spark, earlier.pop())
        with run_folder(spark, make.__name__) as folder:
            earlier.append(folder)
            return make(spark, docs, sf_dir)

    return run_stage


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` of texts that may have changed."""
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


@_stage
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without rejected documents, and without lines that a host repeats."""
    return _counted(quality.apply_rules(docs))


@_stage
def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.deduplicate(docs)


@_stage
def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document has; all documents stay."""
    return _counted(repeats.remove_repeats(docs))


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of each source as often as its target asks for, in mixed order."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    shards = max(LEAST_SHARDS, math.ceil(size / SHARD_BYTES))
    rows = docs.select(
        F.struct("*").alias("row"), F.col("doc_id").alias("key"), "source", mixing.word_count().alias("size")
    )
    return mixing.mix(rows, "key", shards).select("row.*")


@_stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256, ids)`` of every document of the mix."""
    digests = bpe.token_digests(docs, bpe.default_tokenizer(), with_ids=True, words=WORDS, keep=False)
    return digests.withColumnRenamed("key", "doc_id")


STAGES = [
    ("quality rules", keep_good),
    ("near duplicates by SimHash", keep_one),
    ("suffix-array deduplication", cut_passages),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", tokens),
]
# SimHash components, anchors and tokens have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each on the written result of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


@query("pipeline")
def pipeline(spark, sf):
    """Tokens of the finished corpus."""
    return run(spark, sf)

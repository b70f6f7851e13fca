"""Homomorphic multiset fingerprints of documents.

A document is the multiset of its paragraphs' pieces (lines, cut further at sentence ends).
Each piece is hashed to a wide vector of +1 and -1; the fingerprint is their sum, every
component modulo 2**16. Order does not matter, and a piece is added or deleted by adding or
subtracting its vector, without the rest of the text.

Equal fingerprints mean equal multisets. Since the vectors of different pieces are as good
as orthogonal, the squared length of a difference also estimates how many pieces differ,
which gives two fingerprints a likeness between 0 and 1.

Defined cases: a null or empty text, or one of white space only, has the zero fingerprint;
two of these are alike (1), one and another text are not (0). Rows that repeat a key follow
one another in the order of their texts, null keys come first; a single document is its own
successor. Components wrap only where one piece stands 32,768 times or more in a text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelloom.llm.common import ordered_parts, ship
from labelloom.plans.registry import query

WIDTH = 256
_CHUNK = 8192


def cut(text: str) -> str:
    """The text with a line feed wherever a piece ends; no character moves."""
    return text.replace(". ", ".\n").replace("! ", "!\n").replace("? ", "?\n")


def vector_sum(pieces: Iterable[str]) -> np.ndarray:
    """Sum of the pieces' vectors, as wrapping 16-bit numbers."""
    digests = [
        blake2b(p.encode("utf-8", "surrogatepass"), digest_size=WIDTH // 8).digest()
        for p in map(str.strip, pieces) if p
    ]
    total = np.zeros(WIDTH, np.int64)
    for at in range(0, len(digests), _CHUNK):
        some = digests[at : at + _CHUNK]
        bits = np.unpackbits(np.frombuffer(b"".join(some), np.uint8).reshape(-1, WIDTH // 8), axis=1)
        total += 2 * bits.sum(axis=0, dtype=np.int64) - len(some)
    return total.astype(np.int16)


def fingerprint(text: str | None) -> np.ndarray:
    return vector_sum(cut(text or "").split("\n"))


def edit(vector: np.ndarray, deleted: str, inserted: str) -> np.ndarray:
    """Fingerprint after pieces were exchanged, from the one before."""
    return vector - vector_sum(deleted.split("\n")) + vector_sum(inserted.split("\n"))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """1 for equal multisets, about the shared part of the pieces otherwise, 0 for none."""
    square = lambda v: float(np.dot(v.astype(np.float64), v.astype(np.float64)))
    apart, size = square(a - b), square(a) + square(b)
    return 1.0 if apart == 0 else max(0.0, 1.0 - apart / size) if size else 0.0


def as_text(vector: np.ndarray) -> str:
    return vector.astype("<i2").tobytes().hex()


def replace_half(text: str, following: str) -> str:
    """The last half of the text, rounded down, replaced by as much of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compare(text: str, vector: np.ndarray, following: str, after: np.ndarray) -> tuple:
    half = len(text) // 2
    kept, ready = len(text) - half, cut(text)
    # Pieces that end before the edit stay.
    begin = ready.rfind("\n", 0, kept) + 1
    edited = replace_half(text, following)
    changed = edit(vector, ready[begin:], cut(edited[begin:]))
    return (
        len(text), sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), as_text(vector), as_text(changed),
        likeness(vector, changed), likeness(vector, after),
    )


_COLUMNS = (
    "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row of a part with the row behind it; rows of kind 1 only come behind."""
    held = None

    def row(key, result):
        return (key, *result)

    kind = None
    for batch in batches:
        out = []
        kind = batch.schema.field(0).type
        for key, part, side, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            text = text or ""
            vector = fingerprint(text)
            if held is not None and held[1] == part:
                out.append(row(held[0], _compare(held[2], held[3], text, vector)))
            held = None if side else (key, part, text, vector)
        if out:
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], kind), pa.array(columns[1], pa.int64()), *(pa.array(c, pa.string()) for c in columns[2:5]), *(pa.array(c, pa.float64()) for c in columns[5:])],
                names=["key", *(c.split()[0] for c in _COLUMNS.split(", "))],
            )


def with_successor(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every document and of its text edited with the next one.

    Documents go to parts of the key order; the first document of the following part (of
    the first, behind the last) is sent along as a row of kind 1. Texts move once.
    """
    ship(docs.sparkSession)
    rows, parts = ordered_parts(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "key", "text")
    rows = rows.select("key", "part", F.lit(0).alias("kind"), "text")
    # One row per part.
    firsts = rows.groupBy("part").agg(F.min(F.struct("key")).alias("first"))
    by_part = W.orderBy("part")
    whole = by_part.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    sent = firsts.select(
        F.col("part").alias("_from"), "first",
        F.coalesce(F.lag("part").over(by_part), F.max("part").over(whole)).alias("_to"),
    )
    heads = (
        rows.join(F.broadcast(sent), (rows["part"] == sent["_from"]) & rows["key"].eqNullSafe(sent["first.key"]))
        .groupBy("_to").agg(F.min(F.struct("text")).alias("t"), F.first("key").alias("key"))
        .select("key", F.col("_to").alias("part"), F.lit(1).alias("kind"), "t.text")
    )
    kind = rows.schema["key"].dataType.simpleString()
    return (
        rows.union(heads).repartition(parts, "part")
        .sortWithinPartitions("part", "kind", "key", "text")
        .mapInArrow(_pairs, f"key {kind}, {_COLUMNS}")
    )


@query("op10_multiset_fingerprints")
def op10(spark, sf):
    """Fingerprints of all documents and of their edited texts."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return with_successor(docs).withColumnRenamed("key", "doc_id")

"""Ranked lexical search of a query set against all documents, with buckets of equal length.

A document is a vector of term impacts, a query one of term weights, and the score their
inner product. Both are scaled by the root of a term's weight, so that common terms count
little in either length; only terms of the query set are coordinates. Vectors are ordered by
length and cut into buckets. A bucket whose longest vector times the query's length stays
below the query's threshold is skipped (Cauchy-Schwarz). Inside a bucket the query's heaviest
coordinates are added up from the bucket's inverted lists, and what is left is bounded by
the lengths of the two rests. Documents that still reach the threshold are scored exactly, in
64-bit integers. The threshold is the ``k``-th best score known so far: first of a number of
the longest vectors, then of what a task has seen. It only decides what is not worth scoring.

Queries are handled in blocks of about ``BLOCK_TERMS`` terms, so what tasks are handed does
not grow with the query set. Every document is read for every block, in one pass over texts
and one over vectors.

Defined cases: a null or empty text has no terms, is not counted as a document and is never
found; a null or empty query finds nothing; rows that repeat a key, or have none, are documents
(or queries) of their own; equal scores are ranked by ascending key, null keys last; other
columns are ignored; without documents or queries the result is empty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelloom.llm.common import ship
from labelloom.plans.registry import query
from labelloom.storage import written

TOP = 10
# Different terms of the queries of a block; a query is never split.
BLOCK_TERMS = 200_000
# Longest vectors that give the first thresholds.
FIRST_ROWS = 16_384
# Vectors of a bucket.
BUCKET_ROWS = 2048
# Coordinates are looked at until the rest has this part of a query's squared length.
_REST = 0.05
# Bounds are computed in doubles; this covers their rounding.
_SLACK = 1 + 1e-9
# Letters and digits of ASCII, and all bytes of other characters; A-Z become a-z.
_TERMS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)
)
_LARGEST = 2**63


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TERMS).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _query_terms(queries: DataFrame, key: str, text: str) -> DataFrame:
    """``(query, id, term, n)``: a number per row of the query set, its key and its terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(np.array(terms(t), object), return_counts=True) for t in batch.column(2).to_pylist()]
            rows = np.repeat(np.arange(batch.num_rows), [len(t) for t, _ in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)),
                 pa.array([x for t, _ in found for x in t], pa.binary()), pa.array([int(x) for _, n in found for x in n], pa.int64())],
                names=["query", "id", "term", "n"],
            )

    rows = queries.select(F.monotonically_increasing_id().alias("query"), F.col(key).alias("id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"query bigint, id {rows.schema['id'].dataType.simpleString()}, term binary, n bigint")


def _lists(rows: list[np.ndarray], kind) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*rows, []]).astype(kind)))


def _frequencies(docs: DataFrame, key: str, text: str, numbers: dict[bytes, int]) -> DataFrame:
    """``(key, row, n, terms, tf)``: terms of the block in each document that has any term."""
    shared = docs.sparkSession.sparkContext.broadcast(numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for batch in batches:
            sizes, which, often = [], [], []
            for text in batch.column(1):
                found = terms(text.as_py())
                ids, n = np.unique([i for i in map(number, found) if i is not None], return_counts=True)
                sizes.append(len(found))
                which.append(ids)
                often.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), _lists(which, np.int32), _lists(often, np.int32)],
                names=["key", "n", "terms", "tf"],
            )

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return (
        rows.mapInArrow(run, f"key {kind}, n bigint, terms array<int>, tf array<int>")
        .filter("n > 0").withColumn("row", F.monotonically_increasing_id())
    )


class _Bucket:
    """Vectors of a batch: documents by term and terms by document."""

    def __init__(self, batch: pa.RecordBatch, weights: np.ndarray, n_docs: int, n_terms: int):
        column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        self.size = batch.num_rows
        self.key = column["key"]
        self.begin = column["terms"].offsets.to_numpy().astype(np.int64)
        self.begin -= self.begin[0]
        self.terms = column["terms"].flatten().to_numpy()
        tf = column["tf"].flatten().to_numpy().astype(np.int64)
        n = column["n"].to_numpy()
        if 75 * n_docs * int(n.max(initial=0)) < _LARGEST:
            m = 25 + 75 * n * n_docs // n_terms
        else:
            m = np.array([25 + 75 * int(x) * n_docs // n_terms for x in n], np.int64)
        self.doc = np.repeat(np.arange(self.size), np.diff(self.begin))
        self.impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[self.doc])
        self.value = self.impact * np.sqrt(weights[self.terms])
        self.square = np.bincount(self.doc, self.value**2, self.size).astype(float)

    def invert(self) -> None:
        self.order = np.argsort(self.terms, kind="stable")
        self.sorted = self.terms[self.order]

    def bounds(self, query: _Query) -> np.ndarray:
        """At least the score of every document."""
        part, rest = np.zeros(self.size), self.square.copy()
        starts = np.searchsorted(self.sorted, query.focus)
        ends = np.searchsorted(self.sorted, query.focus, "right")
        for a, b, v in zip(starts, ends, query.focus_values, strict=True):
            at = self.order[a:b]
            docs, values = self.doc[at], self.value[at]
            part[docs] += v * values
            rest[docs] -= values**2
        return (part + query.rest * np.sqrt(np.maximum(rest, 0))) * _SLACK + 1

    def scores(self, docs: np.ndarray, full: np.ndarray) -> np.ndarray:
        """Exact scores; ``full`` has the query's integer weight of every term."""
        sizes = self.begin[docs + 1] - self.begin[docs]
        ends = np.cumsum(sizes)
        at = np.repeat(self.begin[docs] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
        sums = np.concatenate([[0], np.cumsum(full[self.terms[at]] * self.impact[at])])
        return sums[ends] - sums[ends - sizes]


class _Query:
    """A query's coordinates, heaviest first, and its best rows so far."""

    def __init__(self, number: int, which: np.ndarray, n: np.ndarray, weights: np.ndarray, least: int, k: int):
        self.number, self.which, self.integers, self.k = number, which, n * weights[which], k
        values = n * np.sqrt(weights[which])
        order = np.argsort(-values, kind="stable")
        squares = values[order] ** 2
        left = squares.sum() - np.cumsum(squares)
        focus = order[: int(np.searchsorted(-left, -_REST * squares.sum())) + 1]
        self.focus, self.focus_values = which[focus], values[focus]
        self.length = math.sqrt(squares.sum())
        self.rest = math.sqrt(max(0.0, squares.sum() - (self.focus_values**2).sum()) + 1e-9 * squares.sum())
        self.least = max(1, least)
        self.best: list[tuple[int, bool, object]] = []

    def take(self, scores: np.ndarray, keys: list) -> None:
        """Keep the ``k`` best rows and raise the threshold."""
        self.best += [(-int(s), key is None, 0 if key is None else key) for s, key in zip(scores, keys, strict=True)]
        self.best = sorted(self.best)[: self.k]
        if len(self.best) == self.k:
            self.least = max(self.least, -self.best[-1][0])


def _search(vectors: DataFrame, block: dict, least: dict[int, int], k: int) -> DataFrame:
    """``(query, key, score)``: the best rows of every task that reach the thresholds."""
    kind = vectors.schema["key"].dataType.simpleString()
    shared = vectors.sparkSession.sparkContext.broadcast((block, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, least = shared.value
        weights = block["weights"]
        queries = [_Query(q, t, n, weights, least.get(q, 0), k) for q, t, n in block["queries"]]
        full = np.zeros(len(weights), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, BUCKET_ROWS):
                bucket = _Bucket(batch.slice(at, BUCKET_ROWS), weights, block["docs"], block["terms"])
                longest = math.sqrt(bucket.square.max(initial=0))
                active = [q for q in queries if q.length * longest * _SLACK + 1 >= q.least]
                if active:
                    bucket.invert()
                for q in active:
                    docs = np.flatnonzero(bucket.bounds(q) >= q.least)
                    full[q.which] = q.integers
                    scores = bucket.scores(docs, full)
                    full[q.which] = 0
                    good = scores >= q.least
                    if good.sum() > k:  # ties with the k-th stay
                        good &= scores >= np.partition(scores[good], -k)[-k]
                    if good.any():
                        q.take(scores[good], bucket.key.take(pa.array(docs[good])).to_pylist())
        rows = [(q.number, None if none else key, -s) for q in queries for s, none, key in q.best]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], key_type), pa.array([r[2] for r in rows], pa.int64())],
            names=["query", "key", "score"],
        )

    from pyspark.sql.pandas.types import to_arrow_type

    key_type = to_arrow_type(vectors.schema["key"].dataType)
    return vectors.select("key", "n", "terms", "tf").mapInArrow(run, f"query bigint, key {kind}, score bigint")


def _lengths(counted: DataFrame, block: dict) -> DataFrame:
    """Add ``length``, the square of a vector's length."""
    shared = counted.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BUCKET_ROWS):
                rows = batch.slice(at, BUCKET_ROWS)
                bucket = _Bucket(rows, shared.value["weights"], shared.value["docs"], shared.value["terms"])
                yield rows.append_column("length", pa.array(bucket.square))

    columns = counted.select("key", "row", "n", "terms", "tf")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in columns.schema)
    return columns.mapInArrow(run, f"{fields}, length double")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query").orderBy(F.desc("score"), F.col("key").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(
    docs: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text", query_key: str = "item_id",
    query_text: str = "text", k: int = TOP, block_terms: int = BLOCK_TERMS, first_rows: int = FIRST_ROWS,
) -> DataFrame:
    """``(id, rank, key, score)``: the ``k`` best documents of each query, scores above 0."""
    spark = docs.sparkSession
    ship(spark)
    asked = written(_query_terms(queries, query_key, query_text), "query-terms")
    blocks = max(1, math.ceil(asked.count() / block_terms))
    results = []
    for number in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == number).select("query", "term", "n").toArrow()
        numbers = {t: i for i, t in enumerate(dict.fromkeys(rows["term"].to_pylist()))}
        counted = written(_frequencies(docs, key, text, numbers), "term-frequencies")
        sums = counted.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
        # One row per term of the block.
        df = counted.select(F.explode("terms").alias("t")).groupBy("t").count().toArrow()
        held = dict(zip(df["t"].to_pylist(), df["count"].to_pylist(), strict=True))
        weights = np.array([weight(sums["docs"], held.get(i, 0)) for i in range(len(numbers))], np.int64)
        by_query: dict[int, tuple[list, list]] = {}
        for q, t, n in zip(*(rows[c].to_pylist() for c in ("query", "term", "n")), strict=True):
            which, often = by_query.setdefault(q, ([], []))
            which.append(numbers[t])
            often.append(n)
        block = {
            "weights": weights, "docs": sums["docs"], "terms": sums["terms"] or 1,
            "queries": [(q, np.array(t), np.array(n)) for q, (t, n) in by_query.items()],
        }
        # Equal lengths, as of copies, are told apart by the row.
        vectors = written(
            _lengths(counted, block).filter("length > 0")
            .repartitionByRange(F.desc("length"), F.xxhash64("row"))
            .sortWithinPartitions(F.desc("length"), F.xxhash64("row")),
            "vectors",
        )
        share = max(0.0, 1 - first_rows / max(1, sums["docs"]))
        cut = vectors.agg(F.percentile_approx("length", share, 10_000).alias("c")).first()["c"]
        if cut is None:
            continue
        first = _best(_search(vectors.filter(F.col("length") >= cut), block, {}, k), k)
        least = {r["query"]: r["score"] for r in first.filter(F.col("rank") == k).select("query", "score").collect()}
        results.append(_search(vectors, block, least, k))
    found = results[0] if results else spark.createDataFrame([], f"query bigint, key {docs.schema[key].dataType.simpleString()}, score bigint")
    for more in results[1:]:
        found = found.union(more)
    names = asked.select("query", "id").distinct()
    return _best(found, k).join(names, "query").select("id", "rank", "key", "score")


SQL = r"""
WITH d AS (
  SELECT doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS t
  FROM documents),
tf AS (SELECT doc_id, t, count(*) AS tf FROM d GROUP BY ALL),
docs AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY ALL),
s AS (SELECT count(*) AS total, sum(n)::BIGINT AS length FROM docs),
q AS (
  SELECT item_id, t, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS t
    FROM benchmark) GROUP BY ALL),
w AS (
  SELECT t, floor(1000 * ln((2 * any_value(total) + 2) / (2 * count(*) + 1)))::BIGINT AS w
  FROM tf CROSS JOIN s WHERE t IN (SELECT t FROM q) GROUP BY t),
m AS (SELECT doc_id, 25 + (75 * n * total) // length AS m FROM docs CROSS JOIN s),
scores AS (
  SELECT item_id, doc_id, sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN w USING (t) JOIN tf USING (t) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0
QUALIFY rank <= 10
"""


@query("op12_lexical_search", SQL)
def op12(spark, sf):
    """The best documents of every benchmark item."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text")
    return search(docs, items).select(F.col("id").alias("item_id"), "rank", F.col("key").alias("doc_id"), "score")

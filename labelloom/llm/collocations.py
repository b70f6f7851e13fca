"""Phrases whose words stand together, found by Toivonen's sampling.

A sample of the documents proposes phrases: those that it holds often enough for a lowered
limit. One full pass then counts, exactly and over all documents, every phrase whose two
parts without the last and without the first word are proposed: the proposals themselves and
their negative border. Phrases of the border that turn out frequent join the proposals, and
a further pass counts the phrases that this makes possible and that no pass has counted yet;
this goes on until the border is closed. A frequent phrase has frequent parts, so by then
every frequent phrase has been counted. What the sample misses costs a pass, never a phrase.

Proposals reach the tasks as a bit table of ``FILTER_BITS`` at most, whatever their number.
A chance hit in it only has one more phrase counted. Each pass has a table of its own and
counts exactly what passes with it and not without it, so no occurrence is counted twice.
Tasks count within chunks of text; sums over chunks are shuffled by phrase.

Defined cases: a null or empty text has no words; a null language is ``und``; rows that
repeat a key or a text count each; without words there are no rows; columns other than text
and language are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelloom.llm.common import ship
from labelloom.operators.lookup import lookup
from labelloom.plans.registry import query
from labelloom.storage import written

LONGEST = 4
MIN_COUNT = 30
TOP = 2000
# A longer candidate with this share of a candidate's count stands for it.
COVERED_PERCENT = 80
UNKNOWN = "und"
# One document of so many is in the sample.
SAMPLE = 8
SAMPLE_LIMIT = 0.8
# Bits of the table of proposals, at most, and bits per proposal.
FILTER_BITS = 1 << 27
_BITS_EACH = 16
# Words that a task counts together.
_CHUNK = 1_000_000
# Rows that a task hands on at a time.
_ROWS = 50_000
_ROLL = np.uint64(0x9E3779B97F4A7C15)
_COUNTS = "lang string, size int, phrase string, n bigint"
# A-Z become a-z, piece ends full stops.
_PLAIN = bytes(
    46 if b in b".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256)
)


class _Numbers(dict):
    """Number of a word in order of first use; the end of a piece is -1."""

    def __init__(self) -> None:
        super().__init__({b".": -1})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) - 1
        return n

    def words(self) -> list[bytes]:
        return list(self)[1:]


def _word_numbers(text: bytes, numbers: _Numbers) -> np.ndarray:
    """Numbers of the words of a text, -1 behind every piece."""
    # Of what split() cuts at, space and tab are left.
    tokens = (text.translate(_PLAIN) + b".").replace(b".", b" . ").split()
    return np.array(list(map(numbers.__getitem__, tokens)), np.int64)


def _hashes(words: list[bytes], lang: str) -> np.ndarray:
    from xxhash import xxh64_intdigest

    seed = xxh64_intdigest(lang.encode())
    return np.fromiter((xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def _slots(hashes: np.ndarray, size: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of a phrase of ``size`` words in a table of ``bits`` (a power of two)."""
    mixed = (hashes + np.uint64(size)) * _ROLL
    mixed ^= mixed >> np.uint64(29)
    last = np.uint64(bits - 1)
    return mixed & last, (mixed >> np.uint64(32)) * _ROLL >> np.uint64(20) & last


def _holds(table: np.ndarray, hashes: np.ndarray, size: int) -> np.ndarray:
    """True where the table of 64-bit words may hold the phrase."""
    found = np.ones(len(hashes), bool)
    for at in _slots(hashes, size, len(table) * 64):
        found &= (table[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return found


def _distinct(ids: np.ndarray, at: np.ndarray, size: int, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """A place and the count of each distinct phrase among those of ``size`` words at ``at``."""
    code = ids[at]
    for k in range(1, size):
        if k > 1:  # dense again, so that the next word fits beside it
            code = np.unique(code, return_inverse=True)[1]
        code = code * n_words + ids[at + k]
    _, first, n = np.unique(code, return_index=True, return_counts=True)
    return at[first], n


def _known(tables: list[np.ndarray], hashes: np.ndarray, size: int) -> np.ndarray:
    found = np.zeros(len(hashes), bool)
    for table in tables:
        found |= _holds(table, hashes, size)
    return found


def _counted_now(tables: list[np.ndarray], rolled: np.ndarray, valid: np.ndarray, size: int) -> np.ndarray:
    """Places whose phrase of ``size`` + 1 words is counted in the pass of the last table."""
    *old, new = tables
    fresh = valid & _holds(new, rolled, size)
    if not old:
        return np.flatnonzero(fresh[:-1] & fresh[1:])
    at = np.flatnonzero(fresh)
    at = np.unique(np.concatenate([at - 1, at]))
    at = at[(at >= 0) & (at < len(valid) - 1)]
    at = at[valid[at] & valid[at + 1]]
    here, next_one = (_known(old, rolled[at + k], size) for k in (0, 1))
    return at[(here | fresh[at]) & (next_one | fresh[at + 1]) & ~(here & next_one)]


def _count_chunk(
    lang: str, ids: np.ndarray, words: list[bytes], tables: list[np.ndarray], longest: int
) -> Iterator[pa.RecordBatch]:
    """Counts of the phrases of one language that one pass counts; all phrases without tables.

    The pass of the first table also counts all words: size 0.
    """
    names = pa.array(words, pa.binary())

    def rows(places: np.ndarray, size: int, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(n), _ROWS):
            some = places[at : at + _ROWS]
            parts = [names.take(pa.array(ids[some + k])) for k in range(size)]
            phrase = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary())) if size > 1 else parts[0]
            yield batch(size, phrase.cast(pa.string()), n[at : at + _ROWS])

    def batch(size: int, phrases: pa.Array, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.repeat(pa.scalar(lang), len(n)), pa.repeat(pa.scalar(size, pa.int32()), len(n)), phrases, pa.array(n, pa.int64())],
            names=["lang", "size", "phrase", "n"],
        )

    valid = ids >= 0
    if len(tables) < 2:
        places, n = _distinct(ids, np.flatnonzero(valid), 1, len(words))
        yield from rows(places, 1, n)
        yield batch(0, pa.array([""]), np.array([valid.sum()]))
    single = _hashes(words, lang)[ids] if words else np.zeros(len(ids), np.uint64)
    rolled = single
    for size in range(2, longest + 1):
        # Whether the phrases of one word less, here and one word on, are proposed.
        at = _counted_now(tables, rolled, valid, size - 1) if tables else np.flatnonzero(valid[:-1] & valid[1:])
        if len(at):
            places, n = _distinct(ids, at, size, len(words))
            yield from rows(places, size, n)
        rolled = rolled[:-1] * _ROLL + single[size - 1 :]
        valid = valid[:-1] & valid[1:]


def _pass(docs: DataFrame, tables: list, longest: int = LONGEST) -> DataFrame:
    """``(lang, size, phrase, n)`` of the phrases that a pass counts; see ``_count_chunk``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_tables = [t.value for t in tables]
        chunk: dict = defaultdict(lambda: (_Numbers(), []))
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, (numbers, found) in chunk.items():
                yield from _count_chunk(lang, np.concatenate(found), numbers.words(), held_tables, longest)
            chunk.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                numbers, found = chunk[lang]
                found.append(_word_numbers(text.as_py(), numbers))
                held += len(found[-1])
                if held >= _CHUNK:
                    yield from flush()
                    held = 0
        yield from flush()

    return docs.mapInArrow(run, _COUNTS).groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))


def _filter_bits(phrases: DataFrame, bits: int) -> np.ndarray:
    """The bit table of proposals: at most ``bits`` bits come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_kind: dict = defaultdict(list)
            for lang, size, phrase in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                by_kind[lang, size].append(phrase.encode().split(b" "))
            for (lang, size), found in by_kind.items():
                single = _hashes([w for p in found for w in p], lang).reshape(-1, size)
                rolled = single[:, 0]
                for k in range(1, size):
                    rolled = rolled * _ROLL + single[:, k]
                at = np.concatenate(_slots(rolled, size, bits))
                mask = (np.uint64(1) << (at & np.uint64(63))).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array(mask)], names=["word", "mask"]
                )

    found = (
        phrases.select("lang", "size", "phrase").mapInArrow(run, "word bigint, mask bigint")
        .groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    )
    table = np.zeros(bits // 64, np.uint64)
    table[found["word"].to_numpy()] = found["mask"].to_numpy().view(np.uint64)
    return table


def frequent_phrases(
    docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT, longest: int = LONGEST,
    sample: int = SAMPLE, filter_bits: int = FILTER_BITS,
) -> tuple[DataFrame, DataFrame]:
    """``(lang, size, phrase, n)`` of all phrases of 1 to ``longest`` words with ``n`` of
    ``min_count`` or more, and ``(lang, n)``: all words. Both are written tables.

    The sample takes documents by a hash of language and text; it only proposes. Its limit is ``SAMPLE_LIMIT`` of what a phrase at ``min_count`` has there on average.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.coalesce(F.col(lang), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    chosen = rows.filter(F.pmod(F.xxhash64("lang", "text"), F.lit(sample)) == 0)
    least = max(1, round(SAMPLE_LIMIT * min_count / sample))
    proposed = written(
        _pass(chosen, [], longest - 1).filter((F.col("n") >= least) & (F.col("size") > 0)).select("lang", "size", "phrase"),
        "proposed-phrases",
    )
    fresh, tables, counted = proposed, [], []
    while True:
        wanted = _BITS_EACH * max(1, fresh.count())
        bits = min(filter_bits, 1 << max(10, (wanted - 1).bit_length()))
        tables.append(spark.sparkContext.broadcast(_filter_bits(fresh, bits)))
        counted.append(written(
            _pass(rows, tables, longest).filter((F.col("n") >= min_count) | (F.col("size") == 0)), "counted-phrases"
        ))
        fresh = written(
            counted[-1].filter(F.col("size").between(1, longest - 1)).join(proposed, ["lang", "phrase"], "left_anti"),
            "border-failures",
        )
        if fresh.isEmpty():
            break
    out = counted[0]
    for more in counted[1:]:
        out = out.unionByName(more)
    return out.filter("size > 0"), counted[0].filter("size = 0").select("lang", "n").filter("n > 0")


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT, top: int = TOP,
    longest: int = LONGEST, sample: int = SAMPLE, filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the ``top`` phrases of each language."""
    counts, totals = frequent_phrases(docs, text, lang, min_count, longest, sample, filter_bits)
    place = F.concat("lang", F.lit("\t"), "phrase")
    known = written(counts.select(place.alias("part"), F.col("n").alias("f")), "phrase-counts")
    candidates = counts.filter("size > 1").select(
        "lang", "phrase", F.col("n").alias("a"), F.col("size").cast("int").alias("size"), F.split("phrase", " ").alias("_w")
    )

    def words(first, n):
        return F.array_join(F.slice("_w", first, n), " ")

    cuts = candidates.select(
        "lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"), "size", "_w"
    ).select(
        "lang", "phrase", "a", "k",
        F.concat("lang", F.lit("\t"), words(F.lit(1), F.col("k"))).alias("left"),
        F.concat("lang", F.lit("\t"), words(F.col("k") + 1, F.col("size") - F.col("k"))).alias("right"),
    )
    for side, count in (("left", "l"), ("right", "r")):
        # ``l`` and ``r`` are counts: the table says how often a part can be asked for.
        cuts = lookup(
            cuts, known.select(F.col("part").alias(side), F.col("f").alias(count)), side, spread="phrase", weight=count
        )
    exact = "decimal(38,0)"
    score = F.expr(f"cast((cast(a AS {exact}) * 2000000) div (l + r) AS bigint)")
    scored = (
        cuts.withColumn("score", score).groupBy("lang", "phrase")
        .agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    )
    spans = [(i, n) for n in range(2, longest) for i in range(1, longest - n + 2)]
    inside = (
        candidates.filter("size > 2")
        .select("lang", "a", "size", F.explode(F.array(*[
            F.when((F.col("size") > n) & (F.col("size") >= i + n - 1), words(i, n)) for i, n in spans
        ])).alias("phrase"))
        .filter("phrase is not null").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    ) if spans else candidates.select("lang", "phrase", F.col("a").alias("longer")).limit(0)
    kept = (
        scored.join(inside, ["lang", "phrase"], "left")
        .filter(F.expr(f"longer is null or cast(longer AS {exact}) * 100 < cast(a AS {exact}) * {COVERED_PERCENT}"))
    )
    best = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (
        kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
        .withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= top)
        .join(F.broadcast(totals), "lang")  # one row per language
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )


SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, '{UNKNOWN}') AS lang, row_number() OVER () AS piece,
    list_filter(string_split(replace(p, chr(9), ' '), ' '), lambda w: w <> '') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
grams AS (
  SELECT lang, size, unnest(list_transform(
    generate_series(1, len(w) - size + 1), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase
  FROM pieces CROSS JOIN (VALUES (1), (2), (3), (4)) AS s(size)),
f AS (SELECT lang, size, phrase, count(*)::BIGINT AS n FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND n >= {MIN_COUNT}),
parts AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail
  FROM c CROSS JOIN (VALUES (1), (2), (3)) AS s(k) WHERE k < size),
cuts AS (
  SELECT parts.*, x.n AS l, y.n AS r, ((2000000::HUGEINT * a) // (x.n + y.n))::BIGINT AS score
  FROM parts JOIN f AS x ON x.lang = parts.lang AND x.phrase = head
    JOIN f AS y ON y.lang = parts.lang AND y.phrase = tail),
cut AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
spans AS (
  SELECT lang, a, unnest(list_transform(
    generate_series(1, size - m + 1), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
  FROM c CROSS JOIN (VALUES (2), (3)) AS s(m) WHERE m < size),
longer AS (SELECT lang, phrase, max(a) AS a FROM spans GROUP BY ALL),
kept AS (
  SELECT cut.* FROM cut LEFT JOIN longer ON cut.lang = longer.lang AND cut.phrase = longer.phrase
  WHERE longer.a IS NULL OR 100::HUGEINT * longer.a < {COVERED_PERCENT}::HUGEINT * cut.a),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT ranked.lang, rank, phrase, a, l, r, totals.n, score
FROM ranked JOIN totals ON ranked.lang = totals.lang WHERE rank <= {TOP}
"""


@query("op11_phrase_collocations", SQL)
def op11(spark, sf):
    """The first phrases of each language."""
    return collocations(spark.read.parquet(f"{sf}/documents.parquet").select("text", "lang"))

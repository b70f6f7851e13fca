"""Scores of texts by a smoothed word model, run as a weighted backoff automaton.

The n-grams of the training texts are the states and arcs of an automaton. An arc carries the
smoothed log-probability of a word after a context, the failure arc of a context leads to the
context without its first word and carries the mass that the context leaves to it. A text is
traversed once from left to right: the state is the longest known context; where it has no arc
for the next word, failure arcs are followed and their weights added.

Single words are discounted absolutely, what that frees goes to the unknown word. Longer
n-grams are smoothed with a prior of ``mu`` words spread as the shorter context says. ``mu``
is chosen by what all training texts show: the prior hands on as much mass as a discount of
(n1 + 1) / (n1 + 2 n2 + 2) of every distinct n-gram would (n1, n2: n-grams seen once, twice).

No task holds the model. Texts are cut into blocks. Each block sends its distinct n-grams with
their training counts, in sorted pieces, to the part of the hash range that they belong to; a
part adds up the counts of all blocks and answers each block with the totals of its n-grams.
From these a block builds its own part of the automaton, which has every arc that its texts can
meet. N-grams are known by a 64-bit hash; the chance of two that agree only shows as a
count in the model.

Defined cases: a null or empty text is its end only; a null key counts as the empty text when
the training rows are chosen, and rows that repeat a key are texts of their own; without
training texts every probability is 1; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import ship
from labelloom.plans.registry import query
from labelloom.storage import written

ORDER = 2
# Rows whose key's crc32 leaves this remainder are not learned from.
FOLDS, HELD_OUT = 7, 2
# Words of a block.
BLOCK_WORDS = 800_000
# N-grams that a part of the hash range gets, roughly.
PART_GRAMS = 2_000_000
# Strengths of the prior to choose from.
PRIORS = [2 ** (k / 2) for k in range(44)]
_END, _BEGIN = 0, 1  # numbers of the marks behind and before a text
_MARKS = [b" end", b" begin"]  # no word has a space
_ROLL = np.uint64(0x9E3779B97F4A7C15)
_STATS = "types bigint, once bigint, twice bigint, tokens bigint, reserved array<bigint>"


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def pack(values: np.ndarray) -> bytes:
    """Whole numbers, all first bytes first: what they have in common packs well."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def unpack(data: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8).reshape(width, -1).T.copy().view(kind).ravel()


def _blocks(docs: DataFrame, key: str, text: str, chosen: Column) -> DataFrame:
    """A row per block of texts: words, texts as word numbers, marks, keys and sizes; to be written."""
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[bytes, int] = {}
        ids: list[np.ndarray] = []
        keys: list = []
        held: list[bool] = []
        size = 0

        def block() -> pa.RecordBatch:
            row = [
                pa.array([secrets.randbits(62)], pa.int64()),
                pa.array([b" ".join(numbers)], pa.binary()),
                pa.array([pack(np.concatenate(ids))], pa.binary()),
                pa.array([np.packbits(held).tobytes()], pa.binary()),
                pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), pa.array(keys, key_type)),
                pa.array([size], pa.int64()), pa.array([held.count(False)], pa.int64()),
            ]
            return pa.RecordBatch.from_arrays(row, names=["block", "words", "ids", "held", "keys", "n_words", "n_trained"])

        for batch in batches:
            for k, t, h in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                found = (t.as_py() or b"").lower().split()
                if size and size + len(found) > BLOCK_WORDS:
                    yield block()
                    numbers, ids, keys, held, size = {}, [], [], [], 0
                ids.append(np.array([*[numbers.setdefault(w, len(numbers) + 2) for w in found], _END], np.uint32))
                keys.append(k)
                held.append(h)
                size += len(found) + 1
        if keys:
            yield block()

    from pyspark.sql.pandas.types import to_arrow_type

    key_type = to_arrow_type(kind)
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"), chosen.alias("held"))
    return rows.mapInArrow(run, f"block bigint, words binary, ids binary, held binary, keys array<{kind.simpleString()}>, n_words bigint, n_trained bigint")


class _Grams:
    """The n-grams of a block, size by size: sorted hashes, training counts, parts."""

    def __init__(self, words: bytes, ids: bytes, held: bytes, order: int):
        from xxhash import xxh64_intdigest

        names = [*_MARKS, *(words.split(b" ") if words else [])]
        self.n_words = len(names)
        hashes = np.fromiter((xxh64_intdigest(w, 42) for w in names), np.uint64, len(names))
        self.ids = unpack(ids, np.uint32).astype(np.int64)
        ends = np.flatnonzero(self.ids == _END)
        self.starts = np.concatenate([[0], ends[:-1] + 1])
        self.ends = ends + 1
        self.held = np.unpackbits(np.frombuffer(held, np.uint8), count=len(ends)).astype(bool)
        # Every text with its mark in front.
        seq = np.insert(self.ids, self.starts, _BEGIN)
        trained = np.repeat(~self.held, self.ends - self.starts + 1)
        single = hashes[seq]
        rolled, valid = single, np.ones(len(seq), bool)
        self.keys, self.counts, self.prefix, self.suffix, self.last = [], [], [], [], []
        before = None
        for size in range(1, order + 1):
            if size > 1:
                rolled = rolled[:-1] * _ROLL + single[size - 1 :]
                valid = valid[:-1] & (seq[size - 1 :] != _BEGIN)
            at = np.flatnonzero(valid)
            mixed = (rolled[at] + np.uint64(size)) * _ROLL
            mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
            key, first, rank = np.unique(mixed, return_index=True, return_inverse=True)
            place = at[first]
            self.keys.append(key)
            self.counts.append(np.bincount(rank[trained[at]], minlength=len(key)).astype(np.uint32))
            self.last.append(seq[place + size - 1])
            whole = np.zeros(len(valid), np.int64)
            whole[at] = rank
            if before is not None:
                self.prefix.append(before[place])
                self.suffix.append(before[place + 1])
            else:
                self.word_rank = np.zeros(self.n_words, np.int64)
                self.word_rank[seq] = rank
                self.prefix.append(None)
                self.suffix.append(None)
            before = whole


def _requests(blocks: DataFrame, order: int, digits: int) -> DataFrame:
    """``(part, block, size, keys, counts)``: the n-grams of every block, by part of the hash range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words, ids, held in zip(*batch.columns, strict=True):
                grams = _Grams(words.as_py(), ids.as_py(), held.as_py(), order)
                for size, (keys, counts) in enumerate(zip(grams.keys, grams.counts, strict=True), 1):
                    parts = _parts(keys, digits)
                    cuts = [*np.flatnonzero(np.diff(parts, prepend=-1)), len(keys)]
                    spans = list(zip(cuts[:-1], cuts[1:], strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([parts[a] for a, _ in spans], pa.int64()), pa.repeat(block, len(spans)), pa.repeat(pa.scalar(size, pa.int32()), len(spans)),
                         pa.array([pack(keys[a:b]) for a, b in spans], pa.binary()), pa.array([pack(counts[a:b]) for a, b in spans], pa.binary())],
                        names=["part", "block", "size", "keys", "counts"],
                    )

    return blocks.select("block", "words", "ids", "held").mapInArrow(run, "part bigint, block bigint, size int, keys binary, counts binary")


def _parts(keys: np.ndarray, digits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - digits)).astype(np.int64) if digits else np.zeros(len(keys), np.int64)


def _totals(table: pa.Table) -> pa.Table:
    """Totals for the blocks of one part, and a row of figures per size."""
    out = []
    sizes = np.array(table["size"])
    for size in np.unique(sizes):
        rows = table.take(pa.array(np.flatnonzero(sizes == size)))
        keys = [unpack(k.as_py(), np.uint64) for k in rows["keys"]]
        counts = np.concatenate([unpack(c.as_py(), np.uint32) for c in rows["counts"]])
        _, rank = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(rank, counts).astype(np.int64)  # exact below 2**53
        answers = np.split(total[rank], np.cumsum([len(k) for k in keys])[:-1])
        part = table["part"][0].as_py()
        found = total[total > 0]
        out += [
            {"block": b.as_py(), "part": part, "size": int(size), "totals": pack(a)}
            for b, a in zip(rows["block"], answers, strict=True)
        ]
        out.append({
            "part": part, "size": int(size), "types": len(found), "once": int((found == 1).sum()), "twice": int((found == 2).sum()),
            "tokens": int(found.sum()), "reserved": [int((found * (mu / (found + mu))).sum()) for mu in PRIORS],
        })
    return pa.Table.from_pylist(out, schema=pa.schema([
        ("block", pa.int64()), ("part", pa.int64()), ("size", pa.int32()), ("totals", pa.binary()), ("types", pa.int64()),
        ("once", pa.int64()), ("twice", pa.int64()), ("tokens", pa.int64()), ("reserved", pa.list_(pa.int64())),
    ]))


def _figures(answers: DataFrame, texts: int, order: int) -> dict:
    """Corpus sizes, the discount of single words and a prior per longer size."""
    sums = answers.filter("block is null").groupBy("size").agg(
        *[F.sum(c).alias(c) for c in ("types", "once", "twice", "tokens")],
        F.array(*[F.sum(F.get("reserved", F.lit(k))) for k in range(len(PRIORS))]).alias("reserved"),
    ).collect()  # a row per size
    by_size = {r["size"]: r.asDict() for r in sums}
    one = by_size.get(1)
    if not one or not texts:
        return {"tokens": 0, "types": 0, "discount": 0.5, "priors": [1.0] * (order - 1)}
    # The mark in front of a text is a context, not a word.
    once, twice = one["once"] - (texts == 1), one["twice"] - (texts == 2)
    priors = []
    for size in range(2, order + 1):
        r, contexts = by_size[size], by_size[size - 1]["reserved"]
        freed = r["types"] * (r["once"] + 1) / (r["once"] + 2 * r["twice"] + 2)
        # Texts end in a word that is no context; with size 2 it is one word.
        ends = [texts * mu / (texts + mu) if size == 2 else 0 for mu in PRIORS]
        gaps = [abs(have - end - freed) for have, end in zip(contexts, ends, strict=True)]
        priors.append(PRIORS[gaps.index(min(gaps))])
    return {
        "tokens": one["tokens"] - texts, "types": one["types"] - 1,
        "discount": (once + 1) / (once + 2 * twice + 2), "priors": priors,
    }


class Automaton:
    """States, arcs and failure arcs for the n-grams of one block; state 0 is the empty context."""

    def __init__(self, grams: _Grams, totals: list[np.ndarray], figures: dict):
        order, tokens, types = len(totals), figures["tokens"], figures["types"]
        self.width = grams.n_words
        discount = figures["discount"]
        unknown = discount * types / tokens if tokens else 1.0
        words = totals[0]
        shorter = np.where(words > 0, (words - discount) / max(1, tokens), unknown)
        # States of the n-grams of the size before, 0 where the n-gram is unknown.
        states = np.zeros(len(words), np.int64)
        self.fail, self.weight_fail = [0], [0.0]
        codes, weights, targets = [], [], []
        origin = np.zeros(len(words), np.int64)
        for size in range(1, order + 1):
            total = totals[size - 1]
            if size > 1:
                prefix, suffix = grams.prefix[size - 1], grams.suffix[size - 1]
                mu = figures["priors"][size - 2]
                shorter = (total + mu * shorter[suffix]) / (totals[size - 2][prefix] + mu)
                origin = states[prefix]
            known = np.flatnonzero(total > 0)
            mine = np.zeros(len(total), np.int64)
            back = states[grams.suffix[size - 1]] if size > 1 else np.zeros(len(total), np.int64)
            if size < order:
                mine[known] = np.arange(len(known)) + len(self.fail)
                mu = figures["priors"][size - 1]
                self.fail += back[known].tolist()
                self.weight_fail += np.log10(mu / (total[known] + mu)).tolist()
            arcs = known[grams.last[size - 1][known] != _BEGIN]
            codes.append(origin[arcs] * self.width + grams.last[size - 1][arcs])
            weights.append(np.log10(shorter[arcs]))
            targets.append(mine[arcs] if size < order else back[arcs])
            states = mine
            if size == 1:
                self.begin = int(mine[grams.word_rank[_BEGIN]])
        self.weight = np.concatenate(weights).tolist()
        self.target = np.concatenate(targets).tolist()
        all_codes = np.concatenate(codes).tolist()
        self.arc = dict(zip(all_codes, range(len(all_codes)), strict=True))
        self.unknown = math.log10(unknown)

    def score(self, words: list[int]) -> float:
        """One traversal of a text's word numbers."""
        arc_of, fail, weight_fail = self.arc.get, self.fail, self.weight_fail
        weight, target, width = self.weight, self.target, self.width
        state, total = self.begin, 0.0
        for w in words:
            arc = arc_of(state * width + w)
            while arc is None and state:
                total += weight_fail[state]
                state = fail[state]
                arc = arc_of(state * width + w)
            if arc is None:
                total += self.unknown
            else:
                total += weight[arc]
                state = target[arc]
        return total


def score(
    docs: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER, chosen: Column | None = None,
) -> DataFrame:
    """``(key, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every text.

    ``chosen`` says which rows are held out; by default ``held_out`` of the key.
    """
    spark = docs.sparkSession
    ship(spark)
    blocks = written(_blocks(docs, key, text, held_out(F.col(key)) if chosen is None else chosen), "text-blocks")
    sums = blocks.agg(F.sum("n_words").alias("words"), F.sum("n_trained").alias("texts")).first()
    digits = max(0, math.ceil(math.log2(max(1, (sums["words"] or 0) * order / PART_GRAMS))))
    answers = written(
        _requests(blocks, order, digits).groupBy("part").applyInArrow(
            _totals, f"block bigint, part bigint, size int, totals binary, {_STATS}"
        ),
        "n-gram-totals",
    )
    figures = _figures(answers, sums["texts"] or 0, order)
    kind = blocks.schema["keys"].dataType.elementType

    def run(block: pa.Table, found: pa.Table) -> pa.Table:
        rows = []
        if block.num_rows:
            grams = _Grams(*(block[c][0].as_py() for c in ("words", "ids", "held")), order)
            totals = []
            for size in range(1, order + 1):
                mine = found.filter(pc.equal(found["size"], size)).sort_by("part")
                pieces = [unpack(t.as_py(), np.int64) for t in mine["totals"]]
                totals.append(np.concatenate([np.zeros(0, np.int64), *pieces]))
            automaton = Automaton(grams, totals, figures)
            counts = totals[0][grams.word_rank][grams.ids]
            base = np.log10((counts + 1) / (figures["tokens"] + figures["types"] + 1))
            n_known = np.add.reduceat((counts > 0).astype(np.int64), grams.starts)
            base_score = np.add.reduceat(base, grams.starts)
            words = [automaton.score(grams.ids[a:b].tolist()) for a, b in zip(grams.starts, grams.ends, strict=True)]
            rows = [block["keys"].combine_chunks().flatten(), pa.array(grams.held), pa.array(grams.ends - grams.starts),
                    pa.array(n_known), pa.repeat(pa.scalar(figures["tokens"], pa.int64()), len(words)), pa.array(base_score), pa.array(words, pa.float64())]
        return pa.table(rows or [pa.array([], t) for t in schema.types], schema=schema)

    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([
        ("key", to_arrow_type(kind)), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
        ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()),
    ])
    return blocks.groupBy("block").cogroup(answers.filter("block is not null").groupBy("block")).applyInArrow(
        run, f"key {kind.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    )


@query("op13_language_model")
def op13(spark, sf):
    """Log-probabilities of every document."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return score(docs).withColumnRenamed("key", "doc_id")

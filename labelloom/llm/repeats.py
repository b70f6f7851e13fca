"""Removal of passages that an earlier document has: suffix-array deduplication in blocks.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a
smaller key. Strings are spread over tasks by content: of each string the 16 bytes with the
least hash are its anchor, so equal strings have equal anchors wherever they stand. A
document falls into stretches, each with the strings of one anchor; a block of documents
looks for repeats as follows.

1. Blocks send the hashes of their anchors, each once, and are told which of them other
   documents have too. Only these can belong to a repeated string.
2. Blocks send the stretches of these anchors, equal ones once with their least key. A task
   gets all stretches of an anchor and sorts the suffixes that start in them. Runs of equal
   strings give the least key; stretches learn which of their strings stand earlier.
3. Blocks mark the bytes and cut them out.

Texts move once, to their blocks; the three passes read the same shuffle. What a block sends
of one anchor or stretch does not grow with its number of copies, so a passage in a third of
all documents is no larger for the task that sorts it than there are blocks and variants.

Defined cases: a null text is empty; matches never cross rows; rows with equal keys do not
remove from each other; a null key counts as larger than all others; all other columns stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import part_count, ship
from labelloom.llm.suffixes import letters, suffix_sort
from labelloom.plans.registry import query

LENGTH = 50
GRAM = 16
# Anchor positions that a string has to choose from.
CHOICE = LENGTH - GRAM + 1
# Bytes of a stretch at most.
STRETCH = LENGTH + CHOICE - 1
# Text of a block, and how many more buckets than blocks there are: the strings that meet in
# a bucket take some ten times their number of 8-byte words.
BLOCK_BYTES = 4_000_000
BUCKETS_PER_BLOCK = 2
_SLICE = 1 << 18
_LAST = np.iinfo(np.int64).max
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def _hashed(text: np.ndarray) -> np.ndarray:
    """64-bit hashes of the ``GRAM`` bytes from every position on."""
    view = letters(text)
    n = len(text) - GRAM + 1
    h = view[:n] * _A
    for at in [*range(8, GRAM - 8, 8), GRAM - 8]:
        h ^= h >> np.uint64(29)
        h += view[at : at + n] * _B
        h *= _C
    h ^= h >> np.uint64(32)
    h *= _A
    return h


class Block:
    """Texts of a block in one buffer, and their stretches: first and last string, anchor."""

    def __init__(self, keys: pa.ChunkedArray, texts: pa.ChunkedArray):
        texts = [t or b"" for t in texts.to_pylist()]
        sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        self.text = np.frombuffer(b"".join(texts) + bytes(STRETCH), np.uint8)
        self.keys = np.array([_LAST if k is None else k for k in keys.to_pylist()], np.int64)
        found = [self._slice(at) for at in range(0, int(self.ends[-1]) if len(texts) else 0, _SLICE)]
        self.first, self.last, self.anchor, self.hash = (
            np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.uint64 if i == 3 else np.int64) for i in range(4)
        )
        self.doc = np.searchsorted(self.ends, self.first, side="right")

    def _slice(self, at: int) -> tuple[np.ndarray, ...]:
        """Stretches of the strings that start at ``at`` and the next ``_SLICE`` positions."""
        total = int(self.ends[-1])
        n = min(_SLICE, total - at)
        hashes = _hashed(self.text[at : min(total, at + n + LENGTH) + GRAM])
        # The least hash and, of equal ones, the first place, in one number.
        least = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
        width = 1
        while width * 2 <= CHOICE:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < CHOICE:
            more = CHOICE - width
            least = np.minimum(least[:-more], least[more:])
        least = least[:n]
        place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        # Strings end inside their document.
        start = np.arange(at, at + len(place))
        d = np.searchsorted(self.ends, [at, at + n - 1], side="right")
        ends = self.ends[d[0] : d[1] + 1]
        end = np.repeat(ends, np.diff(np.r_[at, np.minimum(ends, at + n)]))[: len(place)]
        inside = start + LENGTH <= end
        new = inside.copy()
        new[1:] &= (place[1:] != place[:-1]) | ~inside[:-1]
        heads = np.flatnonzero(new)
        last = np.minimum(np.r_[heads[1:], n] - 1, end[heads] - LENGTH - at)
        return heads + at, last + at, place[heads] + at, hashes[place[heads]]

    def stretches(self, known: np.ndarray) -> None:
        """Keep the stretches whose anchor is in the sorted ``known`` and number equal ones.

        ``number`` is a stretch's content in the order of all contents of the block, so it
        does not depend on the order in which rows arrive.
        """
        at = np.searchsorted(known, short(self.hash))
        at[at == len(known)] = 0
        keep = known[at] == short(self.hash) if len(known) else np.zeros(len(self.hash), bool)
        self.first, self.last, self.anchor, self.hash, self.doc = (
            x[keep] for x in (self.first, self.last, self.anchor, self.hash, self.doc)
        )
        self.strings = self.last - self.first + 1
        rows = np.zeros((len(self.first), STRETCH + 2), np.uint8)
        column = np.arange(STRETCH)
        for a in range(0, len(rows), 65_536):
            b = slice(a, a + 65_536)
            rows[b, 2:] = self.text[np.minimum(self.first[b, None] + column, len(self.text) - 1)]
            rows[b, 2:][column >= (self.strings[b, None] + LENGTH - 1)] = 0
        rows[:, 0], rows[:, 1] = self.anchor - self.first, self.strings
        flat = rows.view(f"V{STRETCH + 2}").ravel() if len(rows) else np.zeros(0, f"V{STRETCH + 2}")
        _, self.one, self.number = np.unique(flat, return_index=True, return_inverse=True)
        self.rows = rows
        self.least = np.full(len(self.one), _LAST)
        np.minimum.at(self.least, self.number, self.keys[self.doc])


def _in_order(table: pa.Table) -> pa.Table:
    """A block's rows by key and text: slices, and so stretches, must not depend on arrival."""
    keys = [_LAST if k is None else k for k in table.column("_key").to_pylist()]
    texts = [t or b"" for t in table.column("_text").to_pylist()]
    return table.take(sorted(range(len(keys)), key=lambda i: (keys[i], texts[i])))


def short(hashes: np.ndarray) -> np.ndarray:
    """The part of a hash that is sent: 48 bits beside the bucket."""
    return hashes & np.uint64((1 << 48) - 1)


def _packed(hashes: np.ndarray) -> bytes:
    return np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    six = np.frombuffer(data, np.uint8).reshape(-1, 6)
    out = np.zeros((len(six), 8), np.uint8)
    out[:, :6] = six
    return out.view("<u8").ravel()


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Even buckets; an anchor's own hash is small, being the least of many."""
    mixed = (hashes * _B) >> np.uint64(32)
    return (mixed * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _by(groups: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Members of each group number."""
    order = np.argsort(groups, kind="stable")
    heads = np.flatnonzero(np.r_[True, np.diff(groups[order]) != 0]) if len(order) else np.zeros(0, np.int64)
    return [(int(groups[m[0]]), m) for m in np.split(order, heads[1:]) if len(m)]


def _anchors(buckets: int):
    """Step 1, blocks: anchors by bucket, those of one and of several documents apart."""

    def run(table: pa.Table) -> pa.Table:
        table = _in_order(table)
        block = Block(table.column("_key"), table.column("_text"))
        by = np.lexsort((block.keys[block.doc], block.hash))
        h, k = block.hash[by], block.keys[block.doc][by]
        new = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
        other = np.r_[False, (h[1:] == h[:-1]) & (k[1:] != k[:-1])] if len(h) else new
        run_of = np.cumsum(new) - 1
        several = np.bincount(run_of, weights=other, minlength=int(new.sum())) > 0 if len(h) else new
        h = h[new]
        out = [
            (b, _packed(h[m][~several[m]]), _packed(h[m][several[m]]))
            for b, m in _by(_bucket(h, buckets))
        ]
        number = table.column("_block")[0].as_py()
        return pa.table({
            "bucket": pa.array([o[0] for o in out], pa.int32()), "_block": pa.array([number] * len(out), pa.int32()),
            "one": pa.array([o[1] for o in out], pa.binary()), "more": pa.array([o[2] for o in out], pa.binary()),
        })

    return run


def _repeated(table: pa.Table) -> pa.Table:
    """Step 1, buckets: to each block its anchors that several documents have."""
    blocks = table.column("_block").to_pylist()
    ones = [_unpacked(x) for x in table.column("one").to_pylist()]
    more = [_unpacked(x) for x in table.column("more").to_pylist()]
    values, counts = np.unique(np.concatenate([*ones, *more]), return_counts=True)
    known = np.union1d(values[counts > 1], np.concatenate(more))
    out = [np.intersect1d(np.concatenate(x), known, assume_unique=True) for x in zip(ones, more, strict=True)]
    return pa.table({
        "_block": pa.array(blocks, pa.int32()), "kind": pa.array([0] * len(blocks), pa.int32()),
        "a": pa.array([_packed(x) for x in out], pa.binary()), "b": pa.array([b""] * len(blocks), pa.binary()),
    })


def _ready(table: pa.Table, told: pa.Table) -> Block:
    block = Block(table.column("_key"), table.column("_text"))
    known = [_unpacked(a) for a, k in zip(told.column("a").to_pylist(), told.column("kind").to_pylist(), strict=True) if k == 0]
    block.stretches(np.unique(np.concatenate(known)) if known else np.zeros(0, np.uint64))
    return block


def _stretches(buckets: int):
    """Step 2, blocks: each different stretch once, by bucket."""

    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        columns: dict[str, list] = {"bucket": [], "_block": [], "numbers": [], "keys": [], "strings": [], "bytes": []}
        if table.num_rows:
            table = _in_order(table)
            block, number = _ready(table, told), table.column("_block")[0].as_py()
            one = block.one
            for b, m in _by(_bucket(block.hash[one], buckets)):
                rows = block.rows[one[m]]
                used = np.arange(STRETCH) < block.strings[one[m], None] + LENGTH - 1
                for name, value in (
                    ("bucket", b), ("_block", number), ("numbers", m.astype("<i4").tobytes()),
                    ("keys", block.least[m].astype("<i8").tobytes()), ("strings", rows[:, 1].tobytes()),
                    ("bytes", rows[:, 2:][used].tobytes()),
                ):
                    columns[name].append(value)
        kinds = {"bucket": pa.int32(), "_block": pa.int32()}
        return pa.table({c: pa.array(v, kinds.get(c, pa.binary())) for c, v in columns.items()})

    return run


def _sorted(table: pa.Table) -> pa.Table:
    """Step 2, buckets: which strings of each stretch have a smaller key elsewhere."""
    get = lambda c, kind: [np.frombuffer(x, kind) for x in table.column(c).to_pylist()]
    strings = get("strings", np.uint8)
    sizes = [len(s) for s in strings]
    count = np.concatenate(strings).astype(np.int64)
    key = np.concatenate(get("keys", "<i8"))
    text = np.frombuffer(b"".join(table.column("bytes").to_pylist()) + bytes(8), np.uint8)
    begin = np.cumsum(count + LENGTH - 1) - (count + LENGTH - 1)
    stretch = np.repeat(np.arange(len(count)), count)
    inside = np.arange(len(stretch)) - np.repeat(np.cumsum(count) - count, count)
    order, fresh = suffix_sort(text, begin[stretch] + inside, LENGTH)
    heads = np.flatnonzero(fresh)
    least = np.minimum.reduceat(key[stretch[order]], heads)[np.cumsum(fresh) - 1]
    earlier = order[least < key[stretch[order]]]
    masks = np.zeros(len(count), np.uint64)
    np.bitwise_or.at(masks, stretch[earlier], np.uint64(1) << inside[earlier].astype(np.uint64))
    out = []
    for block, numbers, mask in zip(
        table.column("_block").to_pylist(), get("numbers", "<i4"), np.split(masks, np.cumsum(sizes)[:-1]), strict=True
    ):
        told = mask != 0
        if told.any():
            out.append((block, numbers[told].tobytes(), mask[told].astype("<u8").tobytes()))
    return pa.table({
        "_block": pa.array([o[0] for o in out], pa.int32()), "kind": pa.array([1] * len(out), pa.int32()),
        "a": pa.array([o[1] for o in out], pa.binary()), "b": pa.array([o[2] for o in out], pa.binary()),
    })


def _cut(columns: list[str], as_text: bool):
    """Step 3, blocks: rows with the bytes that are left of their texts, or the text of these."""

    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        table = _in_order(table)
        block = _ready(table, told)
        masks = np.zeros(len(block.one), np.uint64)
        for kind, a, b in zip(*(told.column(c).to_pylist() for c in ("kind", "a", "b")), strict=True):
            if kind == 1:
                masks[np.frombuffer(a, "<i4")] = np.frombuffer(b, "<u8")
        later = block.keys[block.doc] > block.least[block.number] if len(block.one) else np.zeros(0, bool)
        every = (np.uint64(1) << block.strings.astype(np.uint64)) - np.uint64(1)
        mask = np.where(later, every, masks[block.number] if len(block.one) else every)
        depth = np.zeros(len(block.text) + 1, np.int32)
        for bit in range(CHOICE):
            at = block.first[(mask >> np.uint64(bit)) & np.uint64(1) == 1] + bit
            np.add.at(depth, at, 1)
            np.add.at(depth, at + LENGTH, -1)
        gone = np.cumsum(depth[:-1]) > 0
        removed, spans, kept = [], [], []
        for a, b in zip(block.begins.tolist(), block.ends.tolist(), strict=True):
            g = gone[a:b]
            removed.append(int(g.sum()))
            spans.append(int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()))
            kept.append(block.text[a:b][~g].tobytes() if removed[-1] else block.text[a:b].tobytes())
        out = {c: table.column(c) for c in columns}
        out |= {
            "_n_bytes": pa.array(block.ends - block.begins, pa.int64()), "_n_removed": pa.array(removed, pa.int64()),
            "_n_spans": pa.array(spans, pa.int64()),
            "_kept": pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary()),
        }
        return pa.table(out)

    return run


def cut_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", as_text: bool = False
) -> DataFrame:
    """``docs`` without ``text``, with ``_n_bytes, _n_removed, _n_spans`` and ``_kept`` (binary).

    ``as_text`` returns ``_kept`` as text; a character that lost some of its bytes goes altogether.
    """
    spark = docs.sparkSession
    ship(spark)
    others = [c for c in docs.columns if c != text]
    blocks = max(part_count(docs, text, BLOCK_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")))
    buckets = BUCKETS_PER_BLOCK * blocks
    placed = docs.select(
        *others, F.col(key).cast("long").alias("_key"), F.col(text).cast("binary").alias("_text"),
        F.pmod(F.xxhash64(F.col(key), F.octet_length(text)), F.lit(blocks)).cast("int").alias("_block"),
    ).repartition(blocks, "_block")
    # All steps read the same columns, so that they share one shuffle.
    grouped = placed.groupBy("_block")
    told = "_block int, kind int, a binary, b binary"
    repeated = (
        grouped.applyInArrow(_anchors(buckets), "bucket int, _block int, one binary, more binary")
        .groupBy("bucket").applyInArrow(_repeated, told)
    )
    earlier = (
        grouped.cogroup(repeated.groupBy("_block"))
        .applyInArrow(_stretches(buckets), "bucket int, _block int, numbers binary, keys binary, strings binary, bytes binary")
        .groupBy("bucket").applyInArrow(_sorted, told)
    )
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text]
    return grouped.cogroup(repeated.union(earlier).groupBy("_block")).applyInArrow(
        _cut(others, as_text),
        ", ".join([*kinds, "_n_bytes bigint", "_n_removed bigint", "_n_spans bigint", f"_kept {'string' if as_text else 'binary'}"]),
    )


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with what is left of ``text``; every row stays."""
    left = cut_repeats(docs, key, text, as_text=True)
    return left.drop("_n_bytes", "_n_removed", "_n_spans").withColumnRenamed("_kept", text).select(*docs.columns)


@query("op3_suffix_dedup")
def op3(spark, sf):
    """What is left of every document without passages that an earlier one has."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return cut_repeats(docs).select(
        "doc_id", F.col("_n_bytes").alias("n_bytes"), F.col("_n_removed").alias("n_removed"),
        F.col("_n_spans").alias("n_spans"), F.sha2("_kept", 256).alias("kept_sha256"),
    )

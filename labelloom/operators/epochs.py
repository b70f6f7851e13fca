"""The order of all rows in each of many epochs.

Every epoch has an order of its own, so each row is needed once an epoch where its place is
found. What travels is the rows alone: they are cut into lists by epoch and range of the hash, a
list holds the differences of its sorted integers in as few bytes as they need, and the hashes
are taken anew where a list's range meets. So a row and epoch cost about a byte of disk for
dense keys, instead of the hash, its texts and the row around them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from labelloom.storage import written

# Rows of a hash range, about; rows that are cut into lists at a time, and bytes of them at most.
RANGE_ROWS = 1 << 19
LIST_ROWS, LIST_BYTES = 1 << 18, 64_000_000
# Rows from which a task of its own is worth it, and rows of a task if there are many.
_TASK_ROWS, _MOST_TASK_ROWS = 1 << 16, 1 << 22


def _hasher(seed: object) -> Callable:
    """``(texts, epoch) -> (high, low)``: halves of md5(seed:epoch:text) in the order of its digits.

    A text of NULL leaves ``seed:epoch``. Runs on the executors, so all it needs is inside.
    """
    mask = 0xFFFFFFFF
    sines = [int(abs(math.sin(i + 1)) * 2**32) & mask for i in range(64)]
    turns = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
    start = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
    most, step = 55, 16_384  # bytes of one block; rows whose numbers stay in the cache

    def one_block(words: list) -> list[np.ndarray]:
        """md5 of 16 words each, numbers where all rows agree."""
        a, b, c, d = (np.uint32(x) for x in start)
        for i in range(64):
            if i < 16:
                f, g = d ^ (b & (c ^ d)), i
            elif i < 32:
                f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
            elif i < 48:
                f, g = b ^ c ^ d, (3 * i + 5) % 16
            else:
                f, g = c ^ (b | ~d), (7 * i) % 16
            k, word = sines[i], words[g]
            if isinstance(word, int):
                f = f + a + np.uint32((k + word) & mask)
            else:
                f = f + a + word + np.uint32(k)
            s = turns[i // 16][i % 4]
            a, b, c, d = d, b + ((f << np.uint32(s)) | (f >> np.uint32(32 - s))), b, c
        return [x + np.uint32(y) for x, y in zip((a, b, c, d), start, strict=True)]

    def hashes(texts: pa.Array, epoch: int) -> tuple[np.ndarray, np.ndarray]:
        texts = texts.cast(pa.large_string())
        n = len(texts)
        out = np.empty((n, 4), np.uint32)
        missing = texts.is_null().to_numpy(zero_copy_only=False)
        if missing.any():
            out[missing] = np.frombuffer(hashlib.md5(f"{seed}:{epoch}".encode()).digest(), "<u4")
        if missing.all():
            texts = pa.array([""] * n, pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        sizes = np.diff(offsets)
        prefix = np.frombuffer(f"{seed}:{epoch}:".encode(), np.uint8)
        p = len(prefix)
        with np.errstate(over="ignore"):
            for size in np.unique(sizes[~missing]).tolist():
                rows = np.flatnonzero((sizes == size) & ~missing)
                if p + size > most:
                    for r in rows:
                        message = prefix.tobytes() + data[offsets[r] : offsets[r + 1]].tobytes()
                        out[r] = np.frombuffer(hashlib.md5(message).digest(), "<u4")
                    continue
                first, last = p // 4, (p + size) // 4  # words with bytes of the text
                for i in range(0, len(rows), step):
                    some = rows[i : i + step]
                    block = np.zeros((len(some), 64), np.uint8)
                    block[:, :p] = prefix
                    if size:
                        block[:, p : p + size] = data[offsets[some][:, None] + np.arange(size)]
                    block[:, p + size] = 0x80
                    block[:, 56:58] = np.array([(p + size) * 8], "<u2").view(np.uint8)
                    view = block.view("<u4")
                    words = [
                        np.ascontiguousarray(view[:, j]) if first <= j <= last else int(view[0, j]) for j in range(16)
                    ]
                    for k, x in enumerate(one_block(words)):
                        out[some, k] = x
        big = out.byteswap().astype(np.uint64)
        return (big[:, 0] << np.uint64(32)) | big[:, 1], (big[:, 2] << np.uint64(32)) | big[:, 3]

    return hashes


def _codec() -> tuple[Callable, Callable]:
    """``(pack, unpack)`` of a record batch as bytes; integers without NULLs as differences."""
    def pack(batch: pa.RecordBatch) -> bytes:
        arrays, firsts = [], {}
        for i, values in enumerate(batch.columns):
            if pa.types.is_integer(values.type) and not values.null_count and len(values):
                plain = values.cast(pa.int64()).to_numpy()
                with np.errstate(over="ignore"):
                    steps = np.diff(plain, prepend=plain[:1])
                low, high = int(steps.min()), int(steps.max())
                kind = np.min_scalar_type(high) if low >= 0 else np.promote_types(np.min_scalar_type(low), np.min_scalar_type(high))
                firsts[str(i)] = str(plain[0])
                values = pa.array(steps.astype(kind if kind.itemsize < 8 else np.int64))
            arrays.append(values)
        out = pa.RecordBatch.from_arrays(arrays, names=[str(i) for i in range(len(arrays))])
        out = out.replace_schema_metadata(firsts)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, out.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_batch(out)
        return sink.getvalue().to_pybytes()

    def unpack(data: bytes, schema: pa.Schema) -> pa.RecordBatch:
        with pa.ipc.open_stream(data) as reader:
            firsts = reader.schema.metadata or {}
            batch = reader.read_next_batch()
        arrays = []
        for i, field in enumerate(schema):
            values = batch.column(i)
            if (first := firsts.get(str(i).encode())) is not None:
                steps = values.to_numpy().astype(np.int64)
                steps[0] = int(first)
                with np.errstate(over="ignore"):
                    values = pa.array(np.cumsum(steps))
            arrays.append(values.cast(field.type))
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    return pack, unpack


def epoch_ranks(df: DataFrame, key: str, epochs: int, seed: object = 0, name: str = "rank") -> DataFrame:
    """Every row once an epoch, with ``epoch`` and its rank 1, 2, ... by md5(seed:epoch:key) there.

    Rows of one hash range and epoch meet in a task; ``key`` must be unique.
    """
    kind = df.schema[key].dataType
    whole = isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    # The texts of integers are made where they are hashed.
    rows = df if whole else df.withColumn("_text", F.col(key).cast("string"))
    n = df.count()
    bits = max(0, math.ceil(math.log2(max(1, n / RANGE_ROWS))))
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(n // _TASK_ROWS, 4 * cores), math.ceil(n / _MOST_TASK_ROWS))
    # Near keys together: their differences are small.
    placed = rows.repartitionByRange(tasks, key)
    fields = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in rows.schema.fields])
    text, at = ("_text", None) if not whole else (key, df.columns.index(key))
    hashes, (pack, unpack) = _hasher(seed), _codec()
    most_rows, most_bytes = LIST_ROWS, LIST_BYTES

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lists(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(parts).combine_chunks()
            if at is not None:
                table = table.sort_by(table.column_names[at])
            chunk = table.combine_chunks().to_batches()[0]
            texts = chunk.column(text).cast(pa.string())
            for epoch in range(epochs):
                if bits:
                    bucket = (hashes(texts, epoch)[0] >> np.uint64(64 - bits)).astype(np.uint32 if bits > 16 else np.uint16)
                    order = np.argsort(bucket, kind="stable")
                    there, first = np.unique(bucket[order], return_index=True)
                    sorted_ = chunk.take(pa.array(order))
                else:
                    there, first, sorted_ = np.zeros(1, np.int64), np.zeros(1, np.int64), chunk
                ends = np.append(first[1:], len(chunk))
                data = [pack(sorted_.slice(a, b - a)) for a, b in zip(first.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(there), epoch, np.int32)), pa.array(there.astype(np.int32)),
                     pa.array(ends - first, pa.int64()), pa.array(data, pa.binary())],
                    names=["epoch", "bucket", "n", "data"],
                )

        held, count, size = [], 0, 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                count, size = count + batch.num_rows, size + batch.nbytes
            if count >= most_rows or size >= most_bytes:
                yield from lists(held)
                held, count, size = [], 0, 0
        if held:
            yield from lists(held)

    packed = written(placed.mapInArrow(cut, "epoch int, bucket int, n bigint, data binary"), "epoch-rows")
    counts = packed.groupBy("epoch", "bucket").agg(F.sum("n").alias("n"))
    # One row per epoch and hash range.
    earlier = W.partitionBy("epoch").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select("epoch", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    columns = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField("epoch", T.IntegerType()), T.StructField(name, T.LongType())])
    out = pa.schema([*[fields.field(c) for c in columns], ("epoch", pa.int32()), (name, pa.int64())])

    def ranked(lists: pa.Table, offset: pa.Table) -> pa.Table:
        if not lists.num_rows:
            return out.empty_table()
        epoch, shift = lists["epoch"][0].as_py(), offset["before"][0].as_py()
        table = pa.Table.from_batches([unpack(x.as_py(), fields) for x in lists["data"]]).combine_chunks()
        high, low = hashes(table[text].combine_chunks().cast(pa.string()), epoch)
        order = np.argsort(high, kind="stable")
        if (np.diff(high[order]) == 0).any():
            order = np.lexsort((low, high))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(shift + 1, shift + 1 + len(order))
        arrays = [*[table[c] for c in columns], pa.array(np.full(len(rank), epoch, np.int32)), pa.array(rank)]
        return pa.Table.from_arrays(arrays, schema=out)

    return packed.select("epoch", "bucket", "data").groupBy("epoch", "bucket").cogroup(
        before.groupBy("epoch", "bucket")
    ).applyInArrow(ranked, schema)

"""Looking up what the entries of many rows mean, block by block.

Rows with arrays of entries are gathered into blocks, each with its distinct entries and the
rows as numbers of them. A block asks for every distinct entry once, however often its rows
have it, and the answers meet the block's rows in one task. So neither single entries are
shuffled nor rows put together from them again; an entry is asked for at most once a block,
which also bounds the requests for the most frequent one.

What only the answers need of a block is one compressed value: the JVM moves its bytes and never
holds the arrays.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from labelloom.operators.lookup import lookup
from labelloom.storage import small_batches, written

# Entries of a block; a row with more of them is a block of its own.
BLOCK_ENTRIES = 1_000_000
# Rows that go to Python at a time while blocks are made, since each may have very many entries.
_BATCH_ROWS = 500
# Answers that are sorted by block at a time, and bytes of them at most.
ANSWER_ROWS, ANSWER_BYTES = 500_000, 32_000_000
# A writer holds the rows of a row group, and a reader decodes them together: a block has its own.
_OWN_GROUP = {"parquet.block.row.count.limit": "1", "compression": "zstd"}


def repeats(df: DataFrame, keys: Sequence[str]) -> bool:
    """Whether two rows agree in ``keys``, NULLs taken as equal; only the keys are shuffled."""
    return not df.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1").isEmpty()


def row_blocks(
    df: DataFrame, keep: Sequence[str], entries: str, counts: str | None = None, size: int = BLOCK_ENTRIES
) -> DataFrame:
    """``(block, words, uses, data, rows, sizes, ids, counts)``: a row per block, the first four written.

    ``rows`` are structs of the columns ``keep``, ``sizes`` the numbers of entries of each,
    ``ids`` the entries of all rows as positions in ``words`` (-1: NULL), ``counts`` the array
    column ``counts`` next to them, ``uses`` how often ``ids`` has each word. ``data`` holds rows,
    sizes, ids and counts, which are read from it where they are asked for.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    row = T.StructType([T.StructField(c, kinds[c]) for c in keep])
    word = kinds[entries].elementType
    integers = T.ArrayType(T.IntegerType())
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("words", T.ArrayType(word)), T.StructField("uses", integers),
        T.StructField("data", T.BinaryType()),
    ])
    word_type = to_arrow_type(word)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(values: pa.Array) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

        def packed(**arrays: pa.Array) -> bytes:
            batch = pa.RecordBatch.from_arrays([one(v) for v in arrays.values()], names=list(arrays))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_batch(batch)
            return sink.getvalue().to_pybytes()

        def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(parts).combine_chunks()
            rows, lists, extra = (table.column(i).combine_chunks() for i in range(3))
            sizes = pc.fill_null(pc.list_value_length(lists), 0)
            coded = lists.flatten().cast(word_type).dictionary_encode()
            ids = pc.fill_null(coded.indices.cast(pa.int32()), -1)
            plain = ids.to_numpy(zero_copy_only=False)
            uses = np.bincount(plain[plain >= 0], minlength=len(coded.dictionary)).astype(np.int32)
            data = packed(rows=rows, sizes=sizes.cast(pa.int32()), ids=ids, counts=extra.flatten())
            return pa.RecordBatch.from_arrays(
                [pa.array([secrets.randbits(62)], pa.int64()), one(coded.dictionary), one(pa.array(uses)), pa.array([data], pa.binary())],
                names=["block", "words", "uses", "data"],
            )

        held, n = [], 0
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
            start, before = 0, 0
            while start < batch.num_rows:
                # As many rows as the block still takes, one at least if it is empty.
                stop = int(np.searchsorted(ends, before + size - n, "right"))
                stop = max(stop, start + 1) if not held else max(stop, start)
                if stop > start:
                    held.append(batch.slice(start, stop - start))
                    n += int(ends[stop - 1]) - before
                    start, before = stop, int(ends[stop - 1])
                if start < batch.num_rows or n >= size:
                    yield block(held)
                    held, n = [], 0
        if held:
            yield block(held)

    given = F.col(counts) if counts else F.array().cast("array<bigint>")
    source = df.select(F.struct(*keep).alias("rows"), F.col(entries).alias("entries"), given.alias("counts"))
    with small_batches(df.sparkSession, _BATCH_ROWS):
        blocks = written(source.mapInArrow(run, schema), "blocks", **_OWN_GROUP)

    def part(name: str, kind: T.DataType):
        @F.arrow_udf(kind)
        def read(data: pa.Array) -> pa.Array:
            parts = []
            for value in data:
                with pa.ipc.open_stream(value.as_py()) as reader:
                    parts.append(reader.read_next_batch()[name])
            return pa.concat_arrays(parts)

        return read("data").alias(name)

    arrays = {"rows": T.ArrayType(row), "sizes": integers, "ids": integers, "counts": kinds[counts] if counts else T.ArrayType(T.LongType())}
    return blocks.select("*", *[part(c, kind) for c, kind in arrays.items()])


def term_blocks(counts: DataFrame, keep: Sequence[str], size: int = BLOCK_ENTRIES) -> DataFrame:
    """``row_blocks`` of documents with ``terms``, or of long rows ``(*keep, term, tf)``."""
    if "terms" in counts.columns:
        entries, tf = F.col("terms.term"), F.col("terms.tf")
    else:
        entries, tf = F.array("term"), F.array("tf")
    return row_blocks(counts.select(*keep, entries.alias("_terms"), tf.alias("_tf")), keep, "_terms", "_tf", size)


def block_lookup(
    blocks: DataFrame, table: DataFrame, on: str, weight: str | None, answer: Callable, schema: T.StructType
) -> DataFrame:
    """``schema`` rows that ``answer`` makes of every block and the rows of ``table`` it asked for.

    ``answer(block, found)`` gets the arrays of ``row_blocks`` by name, and an Arrow table with
    ``at``, the positions in ``words``, next to the columns of ``table`` but ``on``. It runs on
    the executors and may only use what it imports.
    """
    asked = blocks.select(F.col("block").alias("asks"), F.posexplode("words").alias("at", on))
    found = lookup(asked, table, on, "asks", weight).drop(on)
    out = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema.fields])
    payload = [c for c in found.columns if c != "asks"]
    word = to_arrow_type(blocks.schema["words"].dataType).value_type
    answers = pa.schema([(c, to_arrow_type(found.schema[c].dataType)) for c in payload])
    most_rows, most_bytes = ANSWER_ROWS, ANSWER_BYTES

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The answers of each block as one value, of many rows at a time."""

        def values(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(parts)
            asks = table.column(0).to_numpy()
            order = np.argsort(asks, kind="stable")
            there, first = np.unique(asks[order], return_index=True)
            chunk = table.select(range(1, table.num_columns)).take(pa.array(order)).cast(answers).combine_chunks().to_batches()[0]
            data = []
            for start, stop in zip(first.tolist(), [*first[1:].tolist(), len(order)], strict=True):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, answers, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                    writer.write_batch(chunk.slice(start, stop - start))
                data.append(sink.getvalue().to_pybytes())
            return pa.RecordBatch.from_arrays([pa.array(there), pa.array(data, pa.binary())], names=["block", "data"])

        held, rows, size = [], 0, 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows, size = rows + batch.num_rows, size + batch.nbytes
            if rows >= most_rows or size >= most_bytes:
                yield values(held)
                held, rows, size = [], 0, 0
        if held:
            yield values(held)

    def run(group: pa.Table) -> pa.Table:
        mine = group["words"].is_valid().to_numpy()
        if not mine.any():
            return out.empty_table()
        arrays, found = {}, []
        for own, value in zip(mine.tolist(), group["data"], strict=True):
            with pa.ipc.open_stream(value.as_buffer()) as reader:
                batch = reader.read_next_batch()
            if own:
                arrays = {c: batch[c].flatten() for c in batch.schema.names}
            else:
                found.append(batch)
        arrays["words"] = group["words"].combine_chunks().flatten().cast(word)
        return pa.table(answer(arrays, pa.Table.from_batches(found, answers).combine_chunks()), schema=out)

    # Blocks and answers are laid out together, by the block.
    given = found.select("asks", *payload).mapInArrow(packed, "block bigint, data binary")
    words = F.lit(None).cast(blocks.schema["words"].dataType).alias("words")
    rows = blocks.select("block", "data", "words").union(given.select("block", "data", words))
    return rows.groupBy("block").applyInArrow(run, schema)

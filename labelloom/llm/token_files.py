"""Token ids in Arrow files of equal-length sequences.

Documents are encoded in key order, each followed by an end id, and packed without gaps
into sequences of one length. A file holds the sequences of one part of the key order as
record batches of a fixed number of rows: ``ids`` is a fixed-size list of the smallest
unsigned type that holds the vocabulary, ``mask`` a fixed-size list of booleans, false only
behind the end of the file's last document. So the place of any token in a file follows
from its number by division, and a memory-mapped batch is read without copying.

A manifest row per document says where it is. A task writes files under names of its own
and only the manifest of the task that Spark commits counts, so a repeated or lost task
leaves at most files that nobody reads. The folder must be one that all executors share.

Defined cases: a null or empty text is its end id only; rows that repeat a key follow one
another in the order of their texts; null keys come first; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelloom.llm.bpe import byte_letters
from labelloom.llm.common import Memory, filesystem, ordered_parts, ship
from labelloom.plans.registry import query
from labelloom.storage import new_path, written

SEQUENCE = 1024
BATCH = 256
END_ID = 2
# Remembered runs between spaces, and pieces of runs; as many of the time before may still be known.
_RUNS, _PIECES = 400_000, 200_000
# New runs after which it is seen whether the memory is full.
_RENEWED = 10_000
# The longest of them worth remembering.
_LONG = 64
# Texts of about so many bytes are encoded at a time.
_TOGETHER = 4_000_000
# Letters that are letters in every version of Unicode, and the pattern by which
# byte-level tokenizers cut texts, for texts of these letters, digits, ASCII marks and line feeds.
_ALPHABET = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0391-\u03a1\u03a3-\u03c9\u0400-\u0481"
_PLAIN_RUN = re.compile(rf"[!-~{_ALPHABET}]+(?:\n[!-~{_ALPHABET}]+)*").fullmatch
_PIECE = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_ALPHABET}]+| ?[0-9]+| ?[^\s{_ALPHABET}0-9]+|\n"
).findall


def _is_open(run: str) -> bool:
    """True if a run is empty or ends in white space: a space behind it belongs to that."""
    return not run[-1:].strip()


class WordEncoder:
    """Ids of texts from the tokenizers library, which sees each word once.

    The pattern of a byte-level tokenizer always cuts before a single space and around a
    single line feed, so the runs between spaces are encoded apart, and remembered; the
    different runs of a batch of texts are looked up once each. New runs of plain letters are
    cut into pieces here, thousands at once, by the same pattern, and new pieces go to the
    library's model; other new runs go to the library as they are. Texts with other runs of
    spaces or with special tokens are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype(np.uint16 if size <= 1 << 16 else np.uint32)
        self._code = "H" if self.dtype == np.uint16 else "I"
        self._special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self._tokenize = self.library.model.tokenize
        self._letters = dict(enumerate(byte_letters()))
        self._plain = self._cuts_alike()
        self._runs = Memory(self._run, _RUNS, _LONG)
        self._pieces = Memory(self._piece, _PIECES, _LONG)
        # Runs of the older memory, and ids of new runs until they are remembered.
        self._before: dict[str, bytes] = {}
        self._made: dict[str, bytes] = {}

    def _cuts_alike(self) -> bool:
        """True if the file's rules are those of a byte-level tokenizer and nothing else."""
        spec = json.loads(self.library.to_str())
        rules, model = spec["pre_tokenizer"] or {}, spec["model"]
        return (
            spec["normalizer"] is None and rules.get("type") == "ByteLevel" and rules.get("use_regex", True)
            and not rules.get("add_prefix_space") and model["type"] == "BPE" and not model["dropout"]
        )

    def _ids(self, text: str) -> bytes:
        return array(self._code, self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece from the library's model."""
        if piece.isascii() and piece != "\n":
            letters = piece.replace(" ", self._letters[32])
        else:
            letters = piece.encode("utf-8").decode("latin-1").translate(self._letters)
        return array(self._code, [t.id for t in self._tokenize(letters)]).tobytes()

    def _run(self, run: str) -> bytes:
        """Ids of a run, which stands behind a space."""
        made = self._made.get(run)
        return self._ids(" " + run) if made is None else made

    def _cut(self, runs: list[str]) -> None:
        """Keep the ids of those runs that are plain, by their pieces, for ``_run``."""
        plain = [run for run in runs if _PLAIN_RUN(run)] if self._plain else []
        pieces = _PIECE("".join([" " + run for run in plain]))
        ids = list(map(self._pieces.__getitem__, pieces))
        # A space begins a run's first piece and no other.
        first = [n for n, piece in enumerate(pieces) if piece[0] == " "]
        self._made = {
            run: ids[i] if j - i == 1 else b"".join(ids[i:j])
            for run, i, j in zip(plain, first, [*first, len(pieces)][1:], strict=True)
        }

    def _renew(self) -> None:
        """Go on with empty memories in front of full ones."""
        runs = self._runs.renewed()
        if runs is not self._runs:
            self._runs, self._before = runs, runs.older
        self._pieces = self._pieces.renewed()

    def encode(self, texts: pa.Array | str) -> list[memoryview] | memoryview:
        """Ids of each text, or of the one that is given alone."""
        if isinstance(texts, str):
            return self.encode(pa.array([texts]))[0]
        texts = texts.cast(pa.large_string())
        split = pc.split_pattern(texts, " ")
        each = split.flatten().dictionary_encode()
        runs, at = each.dictionary.to_numpy(zero_copy_only=False).tolist(), each.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        starts = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
        first, stops = starts[:-1], starts[1:]
        # The first run of a text has no space before it, and so an entry of its own.
        begin = [runs[i] for i in at[first].tolist()]
        at[first] = np.arange(len(runs), len(runs) + len(begin))
        ids = list(map(self._runs.get, runs))
        odd, unknown = [], [i for i, known in enumerate(ids) if known is None]
        for n in range(0, len(unknown), _RENEWED):  # a long text may have more new runs than are remembered
            self._renew()
            some = unknown[n : n + _RENEWED]
            self._cut([runs[i] for i in some if runs[i] not in self._before])
            for i in some:
                # Open runs are never remembered, so each is met here.
                if runs[i] not in self._made and _is_open(runs[i]):
                    odd.append(i)
                    ids[i] = self._ids(" " + runs[i])
                else:
                    ids[i] = self._runs[runs[i]]
            self._made = {}
        ids += [self._ids(run) if run else b"" for run in begin]
        found = pa.array(ids, pa.large_binary()).take(pa.array(at))
        ends = np.frombuffer(found.buffers()[1], np.int64)[: len(at) + 1]
        data = memoryview(found.buffers()[2] or b"")
        out = [data[i:j] for i, j in zip(ends[first].tolist(), ends[stops].tolist(), strict=True)]
        # Texts with an open run before a space, or with a special token, are encoded whole.
        whole = {d for d, run in enumerate(begin) if run and _is_open(run) and stops[d] - first[d] > 1}
        if odd:
            places = np.flatnonzero(np.isin(at, odd))
            text_of = np.searchsorted(stops, places, side="right")
            whole.update(text_of[places != stops[text_of] - 1].tolist())
        for special in self._special:
            whole.update(np.flatnonzero(pc.match_substring(texts, special).to_numpy(zero_copy_only=False)).tolist())
        for d in whole:
            out[d] = memoryview(self._ids(texts[d].as_py()))
        return out


def _slices(texts: pa.Array) -> Iterator[slice]:
    """Rows whose texts have about ``_TOGETHER`` bytes, or one row."""
    total = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + _TOGETHER, side="right")))
        yield slice(at, stop)
        at = stop


@cache
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


class _File:
    """One open file and the tokens that do not fill a batch yet."""

    def __init__(self, folder: str, part: int, dtype: np.dtype, length: int, batch: int):
        self.name = f"{folder}/tokens-{part:07d}-{uuid.uuid4().hex}.arrow"
        system, path = filesystem(self.name)
        self.length, self.batch, self.dtype, self.total = length, batch, dtype, 0
        self._sink = system.open_output_stream(path)
        self._rest: list[np.ndarray] = []
        self._waiting = 0
        self._schema = pa.schema([
            ("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length)),
        ])
        self._writer = pa.ipc.new_file(self._sink, self._schema)

    def add(self, ids: np.ndarray) -> int:
        """Append a document's ids; returns the number of its first token in the file."""
        start = self.total
        self.total += len(ids)
        self._rest.append(ids)
        self._waiting += len(ids)
        full = self.length * self.batch
        if self._waiting >= full:
            flat = np.concatenate(self._rest)
            for at in range(0, len(flat) - full + 1, full):
                self._put(flat[at : at + full], full)
            self._rest = [flat[len(flat) // full * full :].copy()]
            self._waiting = len(self._rest[0])
        return start

    def _put(self, ids: np.ndarray, valid: int) -> None:
        mask = np.zeros(len(ids), bool)
        mask[:valid] = True
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self._writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=self._schema))

    def close(self) -> None:
        flat = np.concatenate(self._rest) if self._rest else np.zeros(0, self.dtype)
        if len(flat):
            rows = -(-len(flat) // self.length)
            padded = np.zeros(rows * self.length, self.dtype)
            padded[: len(flat)] = flat
            self._put(padded, len(flat))
        self._writer.close()
        self._sink.close()


class TokenFile:
    """Random access to a written file."""

    def __init__(self, name: str, length: int = SEQUENCE, batch: int = BATCH):
        system, path = filesystem(name)
        self.length, self.batch = length, batch
        local = type(system).__name__ == "LocalFileSystem"
        self._reader = pa.ipc.open_file(pa.memory_map(path) if local else system.open_input_file(path))
        self._at, self._ids = -1, np.zeros(0)

    def sequence(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of one sequence; the ids are a view of the file."""
        batch = self._reader.get_batch(number // self.batch)
        row = number % self.batch
        ids = batch.column(0).values.to_numpy()[row * self.length : (row + 1) * self.length]
        return ids, np.array(batch.column(1)[row].as_py(), bool)

    def tokens(self, start: int, n: int) -> Iterator[np.ndarray]:
        """Views of the tokens ``start`` to ``start + n``, batch by batch."""
        full, stop = self.length * self.batch, start + n
        while start < stop:
            at = start // full
            if at != self._at:
                self._at, self._ids = at, self._reader.get_batch(at).column(0).values.to_numpy()
            end = min(stop, (at + 1) * full)
            yield self._ids[start - at * full : end - at * full]
            start = end


def write_tokens(
    docs: DataFrame, folder: str, path: str, key: str = "doc_id", text: str = "text",
    end_id: int = END_ID, length: int = SEQUENCE, batch: int = BATCH,
) -> DataFrame:
    """Write the files and return the written manifest: key, part, file, first, n_tokens, start.

    ``first`` counts tokens in the file, ``start`` in the whole order.
    """

    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, file, part = _encoder(path), None, None
        end = np.array([end_id], encoder.dtype).tobytes()
        for rows in batches:
            names, firsts, counts = [], [], []
            texts, parts = pc.fill_null(rows.column(2), ""), rows.column(1).to_pylist()
            encoded = (x for some in _slices(texts) for x in encoder.encode(texts[some]))
            for p, found in zip(parts, encoded, strict=True):
                if p != part:
                    if file:
                        file.close()
                    file, part = _File(folder, p, encoder.dtype, length, batch), p
                ids = np.frombuffer(bytes(found) + end, encoder.dtype)
                names.append(file.name)
                firsts.append(file.add(ids))
                counts.append(len(ids))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), pa.array(names, pa.string()), pa.array(firsts, pa.int64()), pa.array(counts, pa.int64())],
                names=["key", "part", "file", "first", "n_tokens"],
            )
        if file:
            file.close()

    rows, parts = ordered_parts(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "key", "text")
    kind = rows.schema["key"].dataType.simpleString()
    placed = (
        rows.select("key", "part", "text").repartition(parts, "part")
        .sortWithinPartitions("part", "key", "text")
        .mapInArrow(run, f"key {kind}, part int, file string, first bigint, n_tokens bigint")
    )
    system, place = filesystem(folder)
    system.create_dir(place, recursive=True)
    manifest = written(placed, "token-manifest")
    # One row per part.
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")
    )
    return manifest.join(starts, "part").withColumn("start", F.col("before") + F.col("first")).drop("before")


def read_checksums(manifest: DataFrame, length: int = SEQUENCE, batch: int = BATCH) -> DataFrame:
    """Manifest rows with ``ids_crc32``: of the ids as little-endian 32-bit integers, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for rows in batches:
            sums = []
            table = zip(*[rows.column(rows.schema.get_field_index(c)).to_pylist() for c in ("file", "first", "n_tokens")], strict=True)
            for at, first, n in table:
                if at != name:
                    name, file = at, TokenFile(at, length, batch)
                crc = 0
                for ids in file.tokens(first, n):
                    crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                sums.append(crc)
            yield rows.append_column("ids_crc32", pa.array(sums, pa.int64()))

    ship(manifest.sparkSession)
    return (
        manifest.repartition("file").sortWithinPartitions("file", "first")
        .mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in manifest.schema) + ", ids_crc32 bigint")
    )


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


@query("op7_arrow_token_files")
def op7(spark, sf):
    """Place, length and checksum of every document's ids, read back from the files."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    manifest = write_tokens(docs, new_path(spark, "token-files"), default_tokenizer())
    return read_checksums(manifest).select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")

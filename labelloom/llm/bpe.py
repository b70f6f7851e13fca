"""BPE encoding as a streaming transducer, and decoding as a byte-to-text state machine.

The encoding of a text ends in a token; without it, it is the encoding of the shorter text.
A token may follow another exactly if merging the two alone leaves both as they are. So the
last token of every prefix of a word follows from earlier prefixes, in one pass.

No token is longer than the longest one that the merge list makes. That length is the
sufficient lookahead: every encoding that starts like the text so far has a token boundary
among the last so many positions. Tokens before the last boundary that the encodings of all
these positions share are stable, are put out and forgotten; a word of any length passes
through a window of a few times the lookahead. A word that fits the window as a whole is
stable at its end only; its tokens are found by the same relation, longest first. Short words
are remembered, a bounded number of them per task.

Tokenizer files are read by the ``tokenizers`` library's JSON format: BPE with or without
word ends, byte level, split by a pattern. Their path is a parameter.

Defined cases: a null or empty text has no tokens; strings of special tokens in a text are
those tokens; rows that repeat a key, or have none, give a row each.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import Memory, ship
from labelloom.plans.registry import query

# Unicode white space, as pattern engines of tokenizers see it.
WHITE = "\t-\r \x85\xa0  -     　"
_GAPS = re.compile(f"[{WHITE}]+")
# Python's split() also cuts at these, which are not white space.
_NO_GAPS = re.compile("[\x1c-\x1f]")
# Remembered words and runs, with as many of the time before, and the longest worth remembering.
WORDS = 200_000
# Remembered answers to whether one token may follow another.
_PAIRS = 200_000
_LONG = 64
# Runs of a text that are looked up at a time.
_TOGETHER = 50_000
# Rows that a task hands on at a time.
_ROWS = 512
# Positions between two searches for stable tokens.
_STEP = 512


def byte_letters() -> list[str]:
    """A printable character for each byte: itself, or the next free one above 255."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in plain}
    others = [b for b in range(256) if b not in letters]
    letters.update({b: chr(256 + i) for i, b in enumerate(others)})
    return [letters[b] for b in range(256)]


class Merges:
    """A merge list with the questions that the transducer asks of it."""

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]], word_end: str):
        self.vocab, self.word_end = vocab, word_end
        self.rank = {tuple(m): i for i, m in enumerate(merges)}
        self.made = {a + b: (a, b, i) for (a, b), i in self.rank.items()}
        self._follows: dict[tuple[str, str], bool] = {}
        self._whole: dict[str, bool] = {}
        cut = len(word_end)
        self.lookahead = max(
            len(t) - cut if cut and t.endswith(word_end) else len(t) for t in vocab
        )
        # Lengths, longest first, of the tokens inside words that begin with two letters.
        begin: dict[str, set[int]] = {}
        for t in vocab:
            if len(t) > 1 and not (cut and t.endswith(word_end)):
                begin.setdefault(t[:2], set()).add(len(t))
        self._lengths = {k: sorted(v, reverse=True) for k, v in begin.items()}

    def _letters(self, token: str) -> list[str]:
        end = self.word_end
        if end and token.endswith(end) and len(token) > len(end):
            body = token[: -len(end)]
            return [*body[:-1], body[-1] + end]
        return list(token)

    def _merge(self, parts: list[str]) -> list[str]:
        """Short sequences, merge by merge: the definition."""
        rank = self.rank
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: rank.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def forget(self) -> None:
        self._follows.clear()

    def whole(self, token: str) -> bool:
        """True if the letters of a token merge to it."""
        known = self._whole.get(token)
        if known is None:
            known = self._whole[token] = self._merge(self._letters(token)) == [token]
        return known

    def _choices(self, word: str, at: int) -> Iterator[tuple[str, int]]:
        """Tokens that may stand at a place of a word, longest first, with their ends."""
        rest, vocab = word[at:], self.vocab
        last, size = rest + self.word_end, len(rest)
        if last in vocab:
            yield last, at + size
        for n in self._lengths.get(rest[:2], ()):
            if n < size and rest[:n] in vocab:
                yield rest[:n], at + n
        if size > 1 and rest[0] in vocab:
            yield rest[0], at + 1

    def short(self, word: str) -> list[str]:
        """Tokens of a word that fits the window as a whole.

        Longest tokens are tried first; a place from which no token leads on cannot be a
        boundary and is not tried again. What is found is the one sequence in which every
        token may follow the one before it, as ``transduce`` finds it.
        """
        n, out, places, dead = len(word), [], [0], set()
        open_choices = [self._choices(word, 0)]
        while open_choices:
            for token, end in open_choices[-1]:
                if end not in dead and (self.follows(out[-1], token) if out else self.whole(token)):
                    out.append(token)
                    if end == n:
                        return out
                    places.append(end)
                    open_choices.append(self._choices(word, end))
                    break
            else:
                dead.add(places.pop())
                open_choices.pop()
                if out:
                    out.pop()
        raise ValueError(f"no tokens for {word!r}")

    def follows(self, left: str, right: str) -> bool:
        """True if ``right`` may stand after ``left``.

        Going back in time, the part that was merged last falls in two; the parts next to
        the boundary must never have had a merge of their own that came first. Of equal
        merges the left one comes first.
        """
        known = self._follows.get((left, right))
        if known is not None:
            return known
        made, rank = self.made, self.rank
        x, y, limit, known = left, right, 1 << 60, True
        while True:
            if rank.get((x, y), 1 << 60) < limit:
                known = False
                break
            of_x, of_y = made.get(x), made.get(y)
            if of_x and (not of_y or of_x[2] > of_y[2]):
                x, limit = of_x[1], of_x[2]
            elif of_y:
                y, limit = of_y[0], of_y[2] + 1
            else:
                break
        if len(self._follows) >= _PAIRS:
            self._follows.clear()
        self._follows[left, right] = known
        return known


def transduce(letters: Iterable[str], merges: Merges) -> Iterator[str]:
    """Tokens of one word from its letters, each put out once it is stable."""
    vocab, end, reach = merges.vocab, merges.word_end, merges.lookahead
    whole, follows = merges.whole, merges.follows
    window = ""  # letters from the last stable boundary on
    last = [""]  # last[i]: last token of the encoding up to window[:i]

    def token_at(i: int, suffix: str) -> str:
        for j in range(max(0, i - reach), i):
            token = window[j:i] + suffix
            if token in vocab and (follows(last[j], token) if last[j] else whole(token)):
                return token
        raise ValueError(f"no token for {window[max(0, i - reach):i]!r}")

    def path(i: int) -> list[int]:
        stops = [i]
        while i > 0:
            i -= len(last[i])
            stops.append(i)
        return stops[::-1]

    held = None
    for letter in letters:
        if held is not None:
            window += held
            last.append(token_at(len(window), ""))
            if len(window) >= _STEP + reach:
                n = len(window)
                shared = set(path(n))
                for i in range(n - reach + 1, n):
                    shared &= set(path(i))
                cut = max(shared)
                if cut:
                    stops = [s for s in path(n) if s <= cut]
                    yield from (last[s] for s in stops[1:])
                    window, last = window[cut:], last[cut:]
        held = letter
    if held is None:
        return
    window += held
    n = len(window)
    out = [token_at(n, end)]
    i = n - (len(out[0]) - len(end))
    while i > 0:
        out.append(last[i])
        i -= len(last[i])
    yield from out[::-1]


class Decoder:
    """Text from ids, piece by piece; holds only an unfinished character."""

    def __init__(self, tokens: list[str], byte_level: bool):
        self._state = codecs.getincrementaldecoder("utf-8")("replace")
        if byte_level:
            value = {c: b for b, c in enumerate(byte_letters())}
            self.pieces = [
                bytes(value[c] for c in t) if all(c in value for c in t) else t.encode() for t in tokens
            ]
            self._gap = b""
        else:  # a file without a decoder: tokens as they are, a space between them
            self.pieces, self._gap = [t.encode() for t in tokens], b" "
        self._started = False

    def feed(self, ids: Iterable[int]) -> str:
        data = self._gap.join(map(self.pieces.__getitem__, ids))
        if data and self._started:
            data = self._gap + data
        self._started = self._started or bool(data)
        return self._state.decode(data)

    def end(self) -> str:
        """The rest of a text; the decoder is then ready for another."""
        out = self._state.decode(b"", True)
        self._state.reset()
        self._started = False
        return out


class Encoder:
    """Encodes texts by the rules of a tokenizer file."""

    def __init__(self, path: str, words: int = WORDS):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.merges = Merges(
            model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]],
            model.get("end_of_word_suffix") or "",
        )
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        self._nfc, self._lower = "NFC" in kinds, "Lowercase" in kinds
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self._words = regex.compile(split["pattern"]["Regex"].replace(r"\s", WHITE)).findall
        self._letters = {b: c for b, c in enumerate(byte_letters())}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._added = {c: i.to_bytes(4, "little") for c, i in added.items()}
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")").split
        self.tokens = [""] * (max([*model["vocab"].values(), *added.values()]) + 1)
        for t, i in {**model["vocab"], **added}.items():
            self.tokens[i] = t
        self.byte_level = (spec["decoder"] or {}).get("type") == "ByteLevel"
        self._runs = Memory(self._run, words, _LONG)
        self._known = Memory(self._word, words, _LONG)

    def _word(self, word: str) -> bytes:
        letters = word.encode("utf-8").decode("latin-1").translate(self._letters)
        vocab = self.merges.vocab
        tokens = self.merges.short(letters) if len(letters) <= _LONG else transduce(letters, self.merges)
        return b"".join([vocab[t].to_bytes(4, "little") for t in tokens])

    def _run(self, run: str) -> bytes:
        """Ids of a run without white space."""
        text = unicodedata.normalize("NFC", run) if self._nfc else run
        if self._lower:  # letter by letter: a final sigma is no special case
            text = text.replace("Σ", "σ").lower()
        return b"".join(map(self._known.__getitem__, self._words(text)))

    def _plain(self, text: str) -> bytes:
        runs = _GAPS.split(text) if _NO_GAPS.search(text) else text.split()
        out = []
        for at in range(0, len(runs), _TOGETHER):
            self._runs, self._known = self._runs.renewed(), self._known.renewed()
            out += map(self._runs.__getitem__, runs[at : at + _TOGETHER])
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if any(map(text.__contains__, self._added)):
            return b"".join(self._added.get(p) or self._plain(p) for p in self._cut(text))
        return self._plain(text)

    def forget(self) -> None:
        """Drop what is remembered: a worker keeps its memory while others work."""
        self._runs.forget()
        self._known.forget()
        self.merges.forget()

    def decoder(self) -> Decoder:
        return Decoder(self.tokens, self.byte_level)


@cache
def _encoder(path: str, words: int = WORDS) -> Encoder:
    return Encoder(path, words)


def tokenize(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, ids, decoded)``: ids as binary, and the text that they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        decoder = encoder.decoder()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                ids = [encoder.encode(t) for t in part.column(1).to_pylist()]
                texts = [decoder.feed(memoryview(i).cast("I")) + decoder.end() for i in ids]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.binary()), pa.array(texts, pa.string())],
                    names=["key", "ids", "decoded"],
                )
        encoder.forget()

    ship(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, ids binary, decoded string")


def token_digests(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", with_ids: bool = False,
    words: int = WORDS, keep: bool = True,
) -> DataFrame:
    """``(key, n_tokens, ids_sha256, decoded_sha256)``, hashed as the pieces come.

    ``with_ids`` adds the ids as binary, four bytes each. ``words`` bounds what a worker
    remembers; with ``keep`` it still knows it in its next task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, words)
        decoder = encoder.decoder()
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                yield digests(batch.slice(at, _ROWS), encoder, decoder)
        if not keep:
            encoder.forget()

    def digests(batch: pa.RecordBatch, encoder: Encoder, decoder: Decoder) -> pa.RecordBatch:
        n, a, b, all_ids = [], [], [], []
        for t in batch.column(1):
            ids = encoder.encode(t.as_py())
            view = memoryview(ids).cast("I")
            digest = hashlib.sha256()
            for at in range(0, len(view), 65_536):
                digest.update(decoder.feed(view[at : at + 65_536]).encode())
            digest.update(decoder.end().encode())
            n.append(len(view))
            if with_ids:
                all_ids.append(ids)
            a.append(hashlib.sha256(ids).hexdigest())
            b.append(digest.hexdigest())
        columns = {
            "key": batch.column(0), "n_tokens": pa.array(n, pa.int64()),
            "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(b, pa.string()),
        }
        if with_ids:
            columns["ids"] = pa.array(all_ids, pa.binary())
        return pa.RecordBatch.from_pydict(columns)

    ship(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    ids = ", ids binary" if with_ids else ""
    return rows.mapInArrow(run, f"key {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{ids}")


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


@query("op9_bpe_round_trip")
def op9(spark, sf):
    """Token counts and digests of every document."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return token_digests(docs, default_tokenizer()).withColumnRenamed("key", "doc_id")

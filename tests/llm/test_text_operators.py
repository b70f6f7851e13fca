"""Single-document functions against plain definitions and the public library."""

import collections
import random
import re

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from labelloom.llm import bpe, common, multiset, simhash, token_files
from labelloom.llm.mixing import split_quotas
from labelloom.llm.suffixes import suffix_sort

WORD_BPE = str(public_tokenizers.path("word_bpe_49k.json"))
BYTE_BPE = str(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def word_bpe():
    return bpe.Encoder(WORD_BPE), Tokenizer.from_file(WORD_BPE)


@pytest.fixture(scope="module")
def byte_bpe():
    return token_files.WordEncoder(BYTE_BPE), Tokenizer.from_file(BYTE_BPE)


LETTERS = "aabbtthheeiinn'sd 0123é漢字ΣİǅǺ<|>\x1c\x85　!?#…́🙂 \n\t"


def texts(seed, n=600):
    r = random.Random(seed)
    for _ in range(n):
        text = "".join(r.choice(LETTERS) for _ in range(r.randrange(60)))
        if r.random() < 0.15:
            text += r.choice(["<|endoftext|>", "<|startoftext|>", "   x", " \n ", "\t \t"]) + text
        yield text


def test_transducer_equals_library(word_bpe):
    ours, library = word_bpe
    decoder = ours.decoder()
    for text in [*texts(1), "", " ", "a" * 5000 + "the" * 900, "x" * 1200 + " y"]:
        ids = list(memoryview(ours.encode(text)).cast("I")) if text else []
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert decoder.feed(ids) + decoder.end() == library.decode(ids, skip_special_tokens=False)


def test_transducer_puts_tokens_out_early(word_bpe):
    merges = word_bpe[0].merges
    read = 0

    def letters():
        nonlocal read
        for c in "theirintheand" * 2000:
            read += 1
            yield c

    tokens = bpe.transduce(letters(), merges)
    next(tokens)
    assert read < 2 * (512 + merges.lookahead)


def test_decoder_keeps_unfinished_characters():
    letters = bpe.byte_letters()
    decoder = bpe.Decoder([letters[b] for b in "é漢".encode()], byte_level=True)
    assert [decoder.feed([i]) for i in range(5)] == ["", "é", "", "", "漢"]
    assert decoder.feed([0]) == "" and decoder.end() == "�"


PLAIN = ["we'll", "it's", "I'M", "don't.", "'tis", "a''s", "x9y", "12'3", "ab.\nCd", "é--É", "naïve###", "Привет", "αβγ!", "ªº", "ß²", "漢字", "the", "'", "''ve", "a\nb\nc", "ſt", "İx"]


def test_plain_runs_equal_whole_texts_while_memories_fill_up(byte_bpe):
    ours, library = byte_bpe
    r = random.Random(5)
    runs, pieces = ours._runs, ours._pieces
    ours._runs, ours._pieces = common.Memory(ours._run, 7, 5), common.Memory(ours._piece, 5, 5)
    for _ in range(400):
        text = " ".join("".join(r.choices(PLAIN, k=r.randrange(1, 3))) for _ in range(r.randrange(12)))
        ids = np.frombuffer(ours.encode(text), ours.dtype).tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert len(ours._runs) < 7 + 12 and max(map(len, ours._runs), default=0) <= 5
    ours._runs, ours._pieces = runs, pieces


def test_words_apart_equal_whole_texts(byte_bpe):
    ours, library = byte_bpe
    for text in [*texts(2), " a", "a ", "a\n ", "\n\n a  b", ""]:
        ids = np.frombuffer(ours.encode(text), ours.dtype).tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids


def test_simhash_cases():
    assert simhash.simhash(None) == simhash.simhash(b" \n") == 0
    from xxhash import xxh64_intdigest

    assert simhash.simhash(b"Two  Words") == xxh64_intdigest(b"two words", 42)
    assert simhash.simhash("É A b".encode()) == xxh64_intdigest("É a b".encode(), 42)
    assert simhash.simhash(b"a b c d" * 9) == simhash.simhash(b"A B c d" * 9)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab", max_size=70).map(str.encode), min_size=1, max_size=6))
def test_suffix_sort_orders_strings(parts):
    size = 32
    text = np.frombuffer(b"".join(parts) + b"a" * size + bytes(8), np.uint8)
    starts = np.arange(len(text) - size - 7)
    order, fresh = suffix_sort(text, starts, size, 16)
    strings = [text[s : s + size].tobytes() for s in starts]
    placed = [strings[i] for i in order]
    assert placed == sorted(strings)
    assert [bool(f) for f in fresh] == [i == 0 or placed[i] != placed[i - 1] for i in range(len(placed))]


def test_multiset_is_homomorphic_and_keeps_no_order():
    a, b = "One. Two!\nThree", "Three\nTwo! One."
    assert (multiset.fingerprint(a) == multiset.fingerprint(b)).all()
    assert multiset.likeness(multiset.fingerprint(a), multiset.fingerprint(b)) == 1.0
    changed = multiset.edit(multiset.fingerprint(a), "Three", "Four")
    assert (changed == multiset.fingerprint("One. Two!\nFour")).all()
    assert multiset.likeness(multiset.fingerprint(None), multiset.fingerprint(" ")) == 1.0
    assert multiset.likeness(multiset.fingerprint(""), multiset.fingerprint(a)) == 0.0
    many = [f"line {i}" for i in range(200)]
    half = multiset.likeness(multiset.fingerprint("\n".join(many)), multiset.fingerprint("\n".join(many[:100] + [f"x{i}" for i in range(100)])))
    assert abs(half - 0.5) < 0.15


@pytest.mark.parametrize("quotas,shards", [([5, 0, 7], 4), ([0, 0], 3), ([1], 8), ([4096, 12288, 3], 64), ([], 2)])
def test_quotas_add_up(quotas, shards):
    split = split_quotas(quotas, shards, 3)
    assert [sum(s) for s in split] == quotas
    if quotas:
        sizes = [sum(s[k] for s in split) for k in range(shards)]
        assert max(sizes) - min(sizes) <= 2
    assert split == split_quotas(quotas, shards, 3)


def repeated_words(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = collections.Counter(windows)
    return len(w), len({i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(3)})


def test_repeated_words_and_lines(spark):
    from labelloom.llm import quality

    rows = [
        (1, None), (2, ""), (3, "a b c a b c"), (4, "x x x x x"), (5, "l1\nl1\n \nl1\t\nl2"),
        (6, " ".join(f"w{i % 40}" for i in range(120))), (7, "a b"), (8, "a\x0bb\x0cc\rd #&<"), (8, "a\x0bb\x0cc\rd #&<"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = quality.document_counts(df).collect()
    assert len(got) == len(rows)
    for r in got:
        text = r["text"] or ""
        n, repeated = repeated_words(text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r["n_words"], r["n_repeat_words"]) == (n, repeated)
        assert r["word_chars"] == sum(map(len, re.findall(r"[^\x20\x09-\x0D]+", text)))
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text))
        assert r["base_failed"] == (n < 50 or 100 * repeated > 50 * n)


def test_repeated_words_beyond_packed_positions(spark, monkeypatch):
    from labelloom.llm import quality

    monkeypatch.setattr(quality, "POSITION_BITS", 4)
    text = " ".join(f"w{i % 25}" for i in range(60))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert quality.document_counts(df).first()["n_repeat_words"] == repeated_words(text)[1]

"""Batches of texts are encoded as the tokenizers library encodes each of them alone."""

import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from labelloom.llm import token_files

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
ODD = [
    "", " ", "  ", "a", " a", "a ", " a ", "a  b", "  a b", "a b  ", "a\n b", "a \n", "a \n b", "a b\n", "\n a", "a\tb \t c",
    "x  y", "x  y z", "a <|endoftext|> b", "it's we'll 12ab,3. été\nZu", "你好 Ġ x̀ \U0001f600",
    "a\u0085 b", "w" * 200 + " " + "w" * 200, "a b a b a", "a\n", "\x1c b", "b \x1c",
]


def expected(encoder, texts):
    library = Tokenizer.from_file(PATH)
    return [array.array(encoder._code, library.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]


@pytest.mark.parametrize("size", [1, 3, len(ODD)])
def test_batches_equal_the_library(size):
    encoder = token_files.WordEncoder(PATH)
    found = []
    for _ in range(2):  # from an empty memory, then from a full one
        for at in range(0, len(ODD), size):
            found += map(bytes, encoder.encode(pa.array(ODD[at : at + size])))
    assert found == expected(encoder, ODD) * 2


def test_a_slice_equals_the_library():
    encoder = token_files.WordEncoder(PATH)
    assert [*map(bytes, encoder.encode(pa.array(ODD)[5:17]))] == expected(encoder, ODD[5:17])


def test_a_run_is_looked_up_once_a_batch():
    """Found one by one, the 4,000 runs would be 4,000 lookups."""
    encoder = token_files.WordEncoder(PATH)
    asked = []
    runs = encoder._runs
    encoder._runs = type("Counted", (), {
        "renewed": lambda self: self, "get": lambda self, run: asked.append(run) or runs.get(run),
        "__getitem__": lambda self, run: runs[run],
    })()
    encoder.encode(pa.array(["one two three four"] * 1000))
    assert len(asked) <= 4


def test_new_runs_are_cut_together(monkeypatch):
    """Cut one by one, the 3,000 new runs would be 3,000 cuts."""
    cuts = []
    cut = token_files._PIECE
    monkeypatch.setattr(token_files, "_PIECE", lambda text: cuts.append(1) or cut(text))
    encoder = token_files.WordEncoder(PATH)
    texts = [" ".join(f"w{i},{i} it's{i}\nx ({i}) x\u0300{i}" for i in range(k, 1000, 10)) for k in range(10)]
    assert [*map(bytes, encoder.encode(pa.array(texts)))] == expected(encoder, texts)
    assert len(cuts) <= 3


def test_runs_of_full_memories_equal_the_library(monkeypatch):
    """Runs come from the memory, from the older one, and anew, in chunks of a few."""
    monkeypatch.setattr(token_files, "_RUNS", 20)
    monkeypatch.setattr(token_files, "_PIECES", 10)
    monkeypatch.setattr(token_files, "_RENEWED", 7)
    encoder = token_files.WordEncoder(PATH)
    texts = [*ODD, *(" ".join(f"r{(i * k) % 53}'s,\u00e9" for i in range(40)) for k in range(1, 9)), *ODD]
    found = []
    for at in range(0, len(texts), 4):
        found += map(bytes, encoder.encode(pa.array(texts[at : at + 4])))
    assert found == expected(encoder, texts)
    assert encoder._before is encoder._runs._older


def test_slices_hold_all_rows():
    texts = pa.array(["", "a" * 3_000_000, "b" * 3_000_000, "c" * 9_000_000, "", "d"])
    rows = [i for some in token_files._slices(texts) for i in range(*some.indices(len(texts)))]
    assert rows == [*range(6)]
    assert [*token_files._slices(pa.array([], pa.string()))] == []
    assert np.all([s.stop > s.start for s in token_files._slices(texts)])


def test_a_long_text_does_not_fill_the_memory(monkeypatch):
    monkeypatch.setattr(token_files, "_RUNS", 1000)
    monkeypatch.setattr(token_files, "_RENEWED", 100)
    encoder = token_files.WordEncoder(PATH)
    text = " ".join(f"w{i}" for i in range(20_000))
    assert bytes(encoder.encode(pa.array([text]))[0]) == expected(encoder, [text])[0]
    assert len(encoder._runs) <= 1100 and len(encoder._runs._older) <= 1100

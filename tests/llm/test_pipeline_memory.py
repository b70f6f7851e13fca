"""What a worker of the pipeline's BPE stage keeps while other stages run."""

import itertools

import public_tokenizers

import corpus_pipeline
from labelloom.llm import bpe


def test_bpe_stage_remembers_few_words():
    """Idle workers of this stage count as memory of the executor in the stages that follow."""
    encoder = bpe.Encoder(str(public_tokenizers.path("word_bpe_49k.json")), corpus_pipeline.WORDS)
    words = ["".join(w) for w in itertools.islice(itertools.product("bdfgklmn", "aeio", "prstvz", "aeiu", "lnrst", "aeiou", "dkmt"), 90_000)]
    for at in range(0, len(words), 1000):
        encoder.encode(" ".join(words[at : at + 1000]))
        # Those of now and of the time before, of runs and of words.
        known = [len(m) + len(m._older) for m in (encoder._runs, encoder._known)]
        assert max(len(encoder._runs), len(encoder._known)) < 60_000 and max(known) < 115_000

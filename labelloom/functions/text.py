"""Text cleaning and tokenising as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Patterns and word lists that results depend on.
# ---------------------------------------------------------------------------

# Mentions, everything that is not a letter, digit, space or tab, and URLs.
TWEET_NOISE = r"(@[A-Za-z0-9]+)|([^0-9A-Za-z \t])|(\w+:\/\/\S+)"

# Words removed after the regex tokeniser (13 entries, one of them twice).
TOKENIZER_STOP_WORDS = [
    "http", "https", "amp", "rt", "t", "c", "the", "@", "#", "is", "this", "the", "that",
]

# Review text keeps these characters, detaches these suffixes, spaces out these marks.
REVIEW_FOREIGN = r"[^A-Za-z0-9(),!?'`\n]"
REVIEW_SUFFIXES = ["'s", "'ve", "n't", "'re", "'d", "'ll"]
REVIEW_MARKS = [",", "!"]
REVIEW_ESCAPED_MARKS = ["(", ")", "?"]

# The usual English stop-word list, in its customary order.
ENGLISH_STOP_WORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself
yourselves he him his himself she she's her hers herself it it's its itself they them
their theirs themselves what which who whom this that that'll these those am is are was
were be been being have has had having do does did doing a an the and but if or because
as until while of at by for with about against between into through during before after
above below to from up down in out on off over under again further then once here there
when where why how all any both each few more most other some such no nor not only own
same so than too very s t can will just don don't should should've now d ll m o re ve y
ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven
haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn
shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
""".split()

# ---------------------------------------------------------------------------

# Python's idea of a word character and of a non-space, spelled out so that the JVM
# version does not matter (\b and \w change meaning between Java releases).
_WORD = r"[\p{L}\p{N}_]"
_SPACE = r"[\s\p{Z}\x1c-\x1f\x85]"
_NOT_SPACE = r"[^\s\p{Z}\x1c-\x1f\x85]"
# The tweet noise for replacing by blanks that are collapsed afterwards. Same matches, but
# runs are taken at once, and \p{Alnum} is many times faster than the ranges it stands for.
_TWEET_NOISE_RUNS = (
    r"@\p{Alnum}*+|[^\p{Alnum} \t@]+|\p{Alnum}" + _WORD + r"*+:\/\/" + _NOT_SPACE + "+"
)
_REVIEW_FOREIGN_FAST = REVIEW_FOREIGN.replace("A-Za-z0-9", r"\p{Alnum}")


def clean_tweet(text: Column) -> Column:
    """Noise becomes blanks, runs of blanks collapse, ends are trimmed."""
    blanked = F.regexp_replace(text, _TWEET_NOISE_RUNS, " ")
    return F.trim(F.regexp_replace(blanked, r"[ \t]+", " "))


def clean_review(text: Column, faithful: bool = False) -> Column:
    """Space out suffixes and marks, collapse blanks, lower-case; line breaks survive.

    One pass per kind of rule: the suffixes never overlap, so a single alternation gives
    what rule-by-rule replacement gives. ``faithful`` keeps the literal backslash that the
    original emits before ``( ) ?``.
    """
    marks = "".join(REVIEW_MARKS)
    escaped = "".join(REVIEW_ESCAPED_MARKS)
    out = F.regexp_replace(text, _REVIEW_FOREIGN_FAST, " ")
    out = F.regexp_replace(out, "(" + "|".join(REVIEW_SUFFIXES) + ")", " $1")
    if faithful:
        out = F.regexp_replace(out, f"([{marks}])", " $1 ")
        out = F.regexp_replace(out, f"([{escaped}])", r" \\$1 ")
    else:
        out = F.regexp_replace(out, f"([{marks}{escaped}])", " $1 ")
    out = F.regexp_replace(out, " {2,}", " ")
    out = F.regexp_replace(out, " ?\n ?", "\n")
    return F.lower(F.trim(out))


def file_body(text: Column) -> Column:
    """File text with unified line ends and without the one that closes the last line."""
    return F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"\n\z", "")


def file_lines(text: Column) -> Column:
    """Lines of a file; an empty file has none."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(
        F.split(file_body(text), "\n", -1)
    )


def review_words(text: Column, faithful: bool = False) -> Column:
    """Words of a whole review file, line by line.

    With ``faithful`` a blank line counts as one empty word, as splitting it on a blank
    does; otherwise empty words are dropped.
    """
    words = F.split(clean_review(file_body(text), faithful), "[ \n]", -1)
    words = F.when(text == "", F.array().cast("array<string>")).otherwise(words)
    return words if faithful else F.array_remove(words, "")


def strip_stop_words(text: Column, stop_words: Sequence[str] = ENGLISH_STOP_WORDS) -> Column:
    """Delete stop words as whole words, case-sensitively, in list order.

    One alternation does the work of many replacements, unless an earlier entry stands
    inside a later one, which it would have cut in two: such a later entry starts a new pass.
    """
    for words in stop_word_passes(stop_words):
        listed = "|".join(re.escape(w) for w in words)
        text = F.regexp_replace(text, f"(?<!{_WORD})(?:{listed})(?!{_WORD})", "")
    return text


def stop_word_passes(stop_words: Sequence[str]) -> list[list[str]]:
    """The list cut where one alternation would differ from deletion word by word."""
    passes: list[list[str]] = [[]]
    for word in stop_words:
        inside = [
            m.start()
            for w in passes[-1]
            for m in re.finditer(rf"(?<!\w){re.escape(w)}(?!\w)", word)
        ]
        # An earlier entry at its very beginning wins in either form.
        if inside and 0 not in inside:
            passes.append([])
        passes[-1].append(word)
    return passes


def squeeze_lower(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, _SPACE + "+", " "))


def split_space(text: Column, faithful: bool = False) -> Column:
    """Split on single blanks; ``faithful`` keeps the empty token of an empty text."""
    words = F.split(text, " ", -1)
    return words if faithful else F.array_remove(words, "")


def word_tokens(text: Column) -> Column:
    """Lower-case alphanumeric words left after tweet cleaning."""
    return split_space(F.lower(clean_tweet(text)))


def gap_tokens(text: Column) -> Column:
    """Pieces between tweet noise: the cleaning pattern used as a separator."""
    return F.array_remove(F.split(F.lower(text), TWEET_NOISE), "")


def drop_words(tokens: Column, words: Sequence[str]) -> Column:
    """Remove listed words, ignoring case and keeping duplicates of the others."""
    listed = sorted({w.lower() for w in words})
    return F.filter(tokens, lambda w: ~F.lower(w).isin(listed))


def long_words(tokens: Column, stop_words: Sequence[str] = ENGLISH_STOP_WORDS) -> Column:
    """Words of two or more characters that are not stop words."""
    listed = sorted(set(stop_words))
    return F.filter(tokens, lambda w: (F.length(w) >= 2) & ~w.isin(listed))


def unigrams_bigrams(tokens: Column) -> Column:
    """All words followed by all pairs of neighbours."""
    pairs = F.when(
        F.size(tokens) >= 2,
        F.zip_with(
            F.slice(tokens, F.lit(1), F.size(tokens) - 1),
            F.slice(tokens, F.lit(2), F.size(tokens) - 1),
            lambda a, b: F.concat_ws(" ", a, b),
        ),
    ).otherwise(F.array().cast("array<string>"))
    return F.concat(tokens, pairs)

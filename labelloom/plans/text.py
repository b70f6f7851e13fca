"""Text cleaning and tokenising queries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.feature import RegexTokenizer, StopWordsRemover
from pyspark.sql import functions as F

from labelloom.functions import text as T
from labelloom.plans import tables as t
from labelloom.plans.registry import query
from labelloom.sources import readers

_CLEAN_SQL = (
    f"SELECT doc_id, {t.sql_clean_tweet(t.SQL_NOISY_TEXT)} AS clean FROM documents"
)


@query("txt_clean_tweet", _CLEAN_SQL)
def txt_clean_tweet(spark, sf):
    return t.noisy(spark, sf).select("doc_id", T.clean_tweet(F.col("content")).alias("clean"))


@query("udf_text_fn", _CLEAN_SQL)
def udf_text_fn(spark, sf):
    """A Python function over text is a native expression here: the plan has no Python."""
    return t.noisy(spark, sf).select("doc_id", T.clean_tweet(F.col("content")).alias("clean"))


def partition_cleaner(pattern: str):
    """A function over the frames of a partition that cleans one text at a time.

    So a batch never holds the words of all its texts.
    """
    noise = re.compile(pattern)

    def clean(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            text = [None if pd.isna(x) else " ".join(noise.sub(" ", x).split()) for x in frame["content"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "clean": pd.Series(text, index=frame.index, dtype="object")})

    return clean


@query("udf_partition_fn", _CLEAN_SQL)
def udf_partition_fn(spark, sf):
    """A user function over whole partitions, fed with Arrow batches."""
    return t.noisy(spark, sf).mapInPandas(partition_cleaner(T.TWEET_NOISE), "doc_id long, clean string")


@query(
    "txt_clean_review",
    "SELECT doc_id, "
    f"{t.sql_clean_review(t.sql_file_body(t.SQL_NOISY_TEXT))} AS clean, "
    f"{t.sql_clean_review(t.sql_file_body(t.SQL_NOISY_TEXT), True)} AS clean_faithful "
    "FROM documents",
)
def txt_clean_review(spark, sf):
    body = T.file_body(F.col("content"))
    return t.noisy(spark, sf).select(
        "doc_id", T.clean_review(body).alias("clean"),
        T.clean_review(body, faithful=True).alias("clean_faithful"),
    )


# Words are wrapped in marks first, since \b is ASCII-only in the checking engine. Stop words
# with an apostrophe need no rule: their parts are listed before them and go first.
_PLAIN_STOPS = "|".join(w for w in T.ENGLISH_STOP_WORDS if "'" not in w)
_SQL_STRIPPED = (
    f"translate(regexp_replace(regexp_replace({t.SQL_NOISY_TEXT}, "
    "'([\\p{L}\\p{N}_]+)', chr(1) || '\\1' || chr(2), 'g'), "
    f"chr(1) || '({_PLAIN_STOPS})' || chr(2), '', 'g'), chr(1) || chr(2), '')"
)


@query("txt_stopword_regex", f"SELECT doc_id, {_SQL_STRIPPED} AS stripped FROM documents")
def txt_stopword_regex(spark, sf):
    return t.noisy(spark, sf).select(
        "doc_id", T.strip_stop_words(F.col("content")).alias("stripped")
    )


@query(
    "txt_squeeze_lower",
    f"SELECT doc_id, lower(regexp_replace({t.SQL_NOISY_TEXT}, "
    "'[\\s\\p{Z}\\x1c-\\x1f\\x{85}\\x0b]+', ' ', 'g')) AS squeezed FROM documents",
)
def txt_squeeze_lower(spark, sf):
    return t.noisy(spark, sf).select(
        "doc_id", T.squeeze_lower(F.col("content")).alias("squeezed")
    )


@query(
    "txt_split_space",
    "SELECT doc_id, array_to_string(w, '|') AS words, CAST(len(w) AS INTEGER) AS n_words FROM "
    f"(SELECT doc_id, string_split({t.sql_clean_tweet(t.SQL_NOISY_TEXT)}, ' ') AS w FROM documents)",
)
def txt_split_space(spark, sf):
    words = T.split_space(T.clean_tweet(F.col("content")), faithful=True)
    return t.noisy(spark, sf).select(
        "doc_id", t.joined(words, "|").alias("words"), F.size(words).alias("n_words")
    )


_GAPS = t.sql_no_empty(
    f"string_split_regex(lower({t.SQL_NOISY_TEXT}), {t.quoted(T.TWEET_NOISE)})"
)


@query(
    "tok_regex_gaps",
    "SELECT doc_id, array_to_string(w, '|') AS words, CAST(len(w) AS INTEGER) AS n_words FROM "
    f"(SELECT doc_id, {_GAPS} AS w FROM documents)",
)
def tok_regex_gaps(spark, sf):
    """The tokeniser as it is usually written: the cleaning pattern as the separator."""
    rows = t.noisy(spark, sf).filter(F.col("content").isNotNull())
    split = RegexTokenizer(inputCol="content", outputCol="w", pattern=T.TWEET_NOISE)
    return split.transform(rows).select(
        "doc_id", t.joined("w", "|").alias("words"), F.size("w").alias("n_words")
    )


_WORDS = t.sql_word_tokens(t.SQL_NOISY_TEXT)


@query(
    "tok_regex_words",
    "SELECT doc_id, array_to_string(w, '|') AS words, CAST(len(w) AS INTEGER) AS n_words FROM "
    f"(SELECT doc_id, {_WORDS} AS w FROM documents)",
)
def tok_regex_words(spark, sf):
    """The tokens that were meant: words left after mentions and URLs are gone."""
    rows = t.noisy(spark, sf).withColumn("content", T.clean_tweet(F.col("content")))
    match = RegexTokenizer(inputCol="content", outputCol="w", gaps=False, pattern="[0-9A-Za-z]+")
    return match.transform(rows).select(
        "doc_id", t.joined("w", "|").alias("words"), F.size("w").alias("n_words")
    )


_DROP_LIST = "[" + ", ".join(t.quoted(w) for w in dict.fromkeys(T.TOKENIZER_STOP_WORDS)) + "]"


@query(
    "tok_stop_remove",
    "SELECT doc_id, array_to_string(w, '|') AS words FROM (SELECT doc_id, "
    f"list_filter({_WORDS}, lambda x: NOT list_contains({_DROP_LIST}, x)) AS w FROM documents)",
)
def tok_stop_remove(spark, sf):
    rows = t.noisy(spark, sf).select("doc_id", T.word_tokens(F.col("content")).alias("w"))
    remove = StopWordsRemover(inputCol="w", outputCol="kept").setStopWords(T.TOKENIZER_STOP_WORDS)
    return remove.transform(rows).select("doc_id", t.joined("kept", "|").alias("words"))


@query(
    "tok_len_stop",
    "SELECT doc_id, array_to_string(w, '|') AS words FROM (SELECT doc_id, "
    f"{t.sql_long_words(_WORDS)} AS w FROM documents)",
)
def tok_len_stop(spark, sf):
    tokens = T.long_words(T.word_tokens(F.col("content")))
    return t.noisy(spark, sf).select("doc_id", t.joined(tokens, "|").alias("words"))


@query(
    "tok_ngrams_1_2",
    "SELECT doc_id, array_to_string(tokens, '|') AS terms, CAST(len(tokens) AS INTEGER) AS n_terms "
    f"FROM ({t.SQL_GRAMS})",
)
def tok_ngrams_1_2(spark, sf):
    return t.grams(spark, sf).select(
        "doc_id", t.joined("tokens", "|").alias("terms"), F.size("tokens").alias("n_terms")
    )


_LINES = (
    "SELECT doc_id, CAST(line_no - 1 AS INTEGER) AS line_no, line FROM (SELECT doc_id, "
    "unnest(l) AS line, generate_subscripts(l, 1) AS line_no FROM (SELECT doc_id, "
    f"string_split({t.sql_file_body(t.SQL_NOISY_TEXT)}, chr(10)) AS l FROM documents))"
)


@query(
    "src_file_lines",
    "SELECT doc_id, line_no, array_to_string(w, '|') AS words, CAST(len(w) AS INTEGER) AS n_words "
    f"FROM (SELECT doc_id, line_no, string_split({t.sql_clean_review('line', True)}, ' ') AS w "
    f"FROM ({_LINES}))",
)
def src_file_lines(spark, sf):
    """Lines of each file with their cleaned words; a blank line counts one empty word."""
    lines = readers.lines_of(t.noisy(spark, sf), "doc_id", "content")
    return lines.select("doc_id", "line_no", t.joined("words", "|").alias("words"), "n_words")


@query(
    "flt_short_rows",
    "SELECT doc_id, line_no, CAST(len(f) AS INTEGER) AS n_fields FROM (SELECT doc_id, line_no, "
    f"string_split(line, ',') AS f FROM ({_LINES})) WHERE len(f) > 1",
)
def flt_short_rows(spark, sf):
    """Rows of fewer than two fields are dropped."""
    lines = readers.lines_of(t.noisy(spark, sf), "doc_id", "content")
    return lines.select(
        "doc_id", "line_no", F.size(F.split("line", ",")).alias("n_fields")
    ).filter(F.col("n_fields") > 1)


@query(
    "udf_row_predicate",
    "SELECT doc_id, line_no FROM (SELECT doc_id, line_no, string_split(line, ',') AS f "
    f"FROM ({_LINES})) WHERE len(f) = 2",
)
def udf_row_predicate(spark, sf):
    """A Python row predicate becomes a column predicate."""
    lines = readers.lines_of(t.noisy(spark, sf), "doc_id", "content")
    return lines.filter(F.size(F.split("line", ",")) == 2).select("doc_id", "line_no")

"""The given tables in the roles the operators expect, and the same in SQL.

``documents`` play the tweets (label: language or source) and, with their line breaks, the
review files; ``labels`` hold the truthful/deceptive mark; ``embeddings`` are word vectors,
raw scores and numeric features; ``events`` are metrics; ``lineitem`` is the numeric file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.functions import text as T
from labelloom.storage import spread

# ---------------------------------------------------------------------------
# Spark side
# ---------------------------------------------------------------------------


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Columns of the documents, on all cores."""
    return spread(table(spark, sf, "documents").select(*columns), "doc_id")


def tweets(spark: SparkSession, sf: str) -> DataFrame:
    """``(tweet_id, sentiment, author, content)``."""
    return documents(spark, sf, "doc_id", "lang", "source", "text").select(
        F.col("doc_id").alias("tweet_id"), F.col("lang").alias("sentiment"),
        F.col("source").alias("author"), F.col("text").alias("content"),
    )


def noisy_text() -> Column:
    """Document text behind a mention, a URL and contractions, so every rule has work."""
    return F.concat(
        F.lit("@"), F.col("lang"), F.lit("_x https://ex.org/"), F.col("doc_id").cast("string"),
        F.lit("?q=1, It's (ok)? can't they've we're I'd she'll! "), F.col("text"),
    )


def noisy(spark: SparkSession, sf: str) -> DataFrame:
    """``(doc_id, content)`` with text that exercises the cleaners."""
    return documents(spark, sf, "doc_id", "lang", "text").select(
        "doc_id", noisy_text().alias("content")
    )


def words(spark: SparkSession, sf: str, *keep: str) -> DataFrame:
    """``(doc_id, *keep, tokens)``: lower-case words of the cleaned documents."""
    return documents(spark, sf, "doc_id", *keep, "text").select(
        "doc_id", *keep, T.word_tokens(F.col("text")).alias("tokens")
    )


def review_tokens(spark: SparkSession, sf: str, *keep: str) -> DataFrame:
    """``(doc_id, *keep, tokens)``: words of the documents read as review files."""
    return documents(spark, sf, "doc_id", *keep, "text").select(
        "doc_id", *keep, T.review_words(F.col("text")).alias("tokens")
    )


def grams(spark: SparkSession, sf: str, *keep: str) -> DataFrame:
    """``(doc_id, *keep, tokens)``: words of two or more letters without stop words, and pairs."""
    kept = T.long_words(T.word_tokens(F.col("text")))
    return (
        documents(spark, sf, "doc_id", *keep, "text").select("doc_id", *keep, kept.alias("_t"))
        .select("doc_id", *keep, T.unigrams_bigrams(F.col("_t")).alias("tokens"))
    )


def marked(spark: SparkSession, sf: str) -> DataFrame:
    """``(doc_id, actual, predicted)`` with two 0/1 marks as truth and prediction."""
    return table(spark, sf, "labels").select(
        "doc_id", F.col("quality").alias("actual"), F.col("toxic").alias("predicted")
    )


def rounded(column: str | Column, digits: int = 6) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, digits)


def joined(column: str | Column, by: str = " ") -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.array_join(column.cast("array<string>"), by)


# ---------------------------------------------------------------------------
# SQL side
# ---------------------------------------------------------------------------


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SQL_NOISE = quoted(
    T.TWEET_NOISE.replace(r"\w", r"[\p{L}\p{N}_]").replace(r"\S", r"[^\s\p{Z}\x1c-\x1f\x{85}]")
)

SQL_NOISY_TEXT = (
    "concat('@', lang, '_x https://ex.org/', doc_id, "
    "'?q=1, It''s (ok)? can''t they''ve we''re I''d she''ll! ', text)"
)


def sql_clean_tweet(x: str) -> str:
    return (
        f"trim(regexp_replace(regexp_replace({x}, {SQL_NOISE}, ' ', 'g'), '[ \\t]+', ' ', 'g'))"
    )


def sql_no_empty(x: str) -> str:
    return f"list_filter({x}, lambda w: w <> '')"


def sql_word_tokens(x: str) -> str:
    return sql_no_empty(f"string_split(lower({sql_clean_tweet(x)}), ' ')")


def sql_file_body(x: str) -> str:
    return (
        f"regexp_replace(regexp_replace({x}, '\\r\\n?', chr(10), 'g'), '\\n\\z', '')"
    )


def sql_clean_review(x: str, faithful: bool = False) -> str:
    """Rule by rule, in the original order."""
    out = f"regexp_replace({x}, '[^A-Za-z0-9(),!?''`\\n]', ' ', 'g')"
    for suffix in T.REVIEW_SUFFIXES:
        s = suffix.replace("'", "''")
        out = f"replace({out}, '{s}', ' {s}')"
    for mark in T.REVIEW_MARKS:
        out = f"replace({out}, '{mark}', ' {mark} ')"
    for mark in T.REVIEW_ESCAPED_MARKS:
        out = f"replace({out}, '{mark}', ' {chr(92) if faithful else ''}{mark} ')"
    out = f"regexp_replace({out}, ' {{2,}}', ' ', 'g')"
    out = f"regexp_replace({out}, ' ?\\n ?', chr(10), 'g')"
    return f"lower(trim({out}))"


def sql_review_words(x: str, faithful: bool = False) -> str:
    words = (
        f"string_split_regex({sql_clean_review(sql_file_body(x), faithful)}, '[ \\n]')"
    )
    words = f"(CASE WHEN {x} = '' THEN [] ELSE {words} END)"
    return words if faithful else sql_no_empty(words)


SQL_STOP_LIST = "[" + ", ".join(quoted(w) for w in T.ENGLISH_STOP_WORDS) + "]"


def sql_long_words(tokens: str) -> str:
    return (
        f"list_filter({tokens}, lambda w: length(w) >= 2 "
        f"AND NOT list_contains({SQL_STOP_LIST}, w))"
    )


def sql_grams(tokens: str) -> str:
    return (
        f"list_concat({tokens}, list_transform(generate_series(1, len({tokens}) - 1), "
        f"lambda i: {tokens}[i] || ' ' || {tokens}[i + 1]))"
    )


SQL_TWEETS = (
    "SELECT doc_id AS tweet_id, lang AS sentiment, source AS author, text AS content "
    "FROM documents"
)
SQL_WORDS = f"SELECT *, {sql_word_tokens('text')} AS tokens FROM documents"
SQL_REVIEW = f"SELECT *, {sql_review_words('text')} AS tokens FROM documents"
SQL_GRAMS = (
    f"SELECT doc_id, lang, source, {sql_grams('t')} AS tokens FROM "
    f"(SELECT doc_id, lang, source, {sql_long_words('tokens')} AS t FROM ({SQL_WORDS}))"
)


def sql_counts(docs: str, *keep: str) -> str:
    """Long-form term counts of ``docs``, a query with ``doc_id`` and ``tokens``."""
    k = "".join(f", {c}" for c in keep)
    return (
        f"SELECT doc_id{k}, term, count(*) AS tf FROM "
        f"(SELECT doc_id{k}, unnest(tokens) AS term FROM ({docs})) GROUP BY ALL"
    )


def sql_hash(key: str, seed: object) -> str:
    return f"md5(concat('{seed}:', {key}))"


def sql_vocabulary(docs: str) -> str:
    """Words with uses and ids in hash order."""
    return (
        "SELECT word, uses, row_number() OVER (ORDER BY md5('word:' || word), word) AS word_id "
        "FROM (SELECT word, count(*) AS uses FROM "
        f"(SELECT unnest(tokens) AS word FROM ({docs})) GROUP BY word)"
    )


SQL_MARKED = "SELECT doc_id, quality AS actual, toxic AS predicted FROM labels"

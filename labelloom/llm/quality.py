"""Quality rules: counts inside a document, and lines that a host repeats across documents.

Everything is built from column expressions. A document's counts never leave its row. One
hash per distinct line of a document is written once and counted per host; lines that too
many different documents of a host hold are removed, and documents that are left with too
little are rejected.

Defined cases: a null text has no words and fails; documents without a host (null) are one
host; equal texts of a host count as one document, so copies do not condemn each other
(deduplication is another stage); an empty table gives an empty result; columns of the
input other than key, text and host are ignored by ``verdicts`` and kept by ``apply_rules``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.plans.registry import query
from labelloom.storage import written

SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
# A line is removed if more different documents of its host than LINE_DOCS hold it, and more
# than LINE_PERCENT of the host's different documents.
LINE_DOCS = 20
LINE_PERCENT = 1
# A document must keep this share of its word characters outside such lines.
KEPT_PERCENT = 50
# Positions that fit beside a hash in one number, see ``with_repeated_words``.
POSITION_BITS = 20
# Copies of the table of removed lines, so that a line in a third of all documents is
# looked up by this many tasks.
SALTS = 16
# Lists of removed lines are broadcast up to this size, all together and for one host.
LIST_BYTES, LIST_LINES = 8_000_000, 1000


def _spaced(text: Column) -> Column:
    """Tab, vertical tab, form feed and carriage return as spaces; line feeds stay."""
    for gap in ("\t", "\r", "\x0b", "\x0c"):
        text = F.replace(text, F.lit(gap), F.lit(" "))
    return text


def _squeezed(text: Column) -> Column:
    return F.replace(_spaced(text), F.lit(" "), F.lit(""))


def line_hash(line: Column) -> Column:
    """Hash of a normalised line: lower case, no white space."""
    return F.xxhash64(F.lower(_squeezed(line)))


def line_entries(lines: Column) -> Column:
    """Of each line with a word: normalised hash ``h``, hash as it is ``r``, word characters ``c``.

    ``lines`` must be a column of its own.
    """
    entries = F.transform(
        F.transform(lines, _squeezed),
        lambda z, i: F.struct(
            F.xxhash64(F.lower(z)).alias("h"), F.xxhash64(F.get(lines, i)).alias("r"), F.char_length(z).alias("c")
        ),
    )
    return F.filter(entries, lambda e: e["c"] > 0)


def with_repeated_words(df: DataFrame, tokens: str, name: str, window: int = 3) -> DataFrame:
    """Add ``name``: words inside windows of ``window`` words that ``tokens`` holds again.

    Words, then windows are hashed in place. Only if some window's hash repeats are the
    hashes sorted with their positions, low hash bits and position in one number: equal
    neighbours may be repeats, and those few are compared in full. Each repeated window
    covers the words up to the next one, ``window`` at most. Every array that a lambda looks
    into is a column used more than once, so that it is computed once per row.
    """
    w, g, h, p, s, at = (F.col(c) for c in (tokens, "_words", "_hashes", "_packed", "_sorted", "_at"))
    hashes = F.slice(
        F.transform(g, lambda x, i: F.xxhash64(x, *[F.get(g, i + k) for k in range(1, window)])),
        1, F.size(g) - (window - 1),
    )
    some = F.size(F.array_distinct(h)) < F.size(h)
    size = 2**POSITION_BITS
    packed = F.sort_array(F.transform(h, lambda x, i: F.shiftleft(x, POSITION_BITS).bitwiseOR(i.cast("bigint"))))
    near = F.filter(p, lambda x, k: (
        (F.shiftright(F.get(p, k - 1), POSITION_BITS) == F.shiftright(x, POSITION_BITS))
        | (F.shiftright(F.get(p, k + 1), POSITION_BITS) == F.shiftright(x, POSITION_BITS))
    ))
    found = F.transform(near, lambda x: x.bitwiseAND(size - 1).cast("int"))
    # A text of more windows than the position holds has all of them compared in full.
    candidates = F.when(F.size(h) < size, found).otherwise(F.sequence(F.lit(0), F.size(h) - 1))
    ordered = F.sort_array(F.transform(candidates, lambda i: F.struct(F.get(h, i).alias("h"), i.alias("i"))))
    same = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))
    covered = F.aggregate(
        F.transform(at, lambda p, k: F.least(F.coalesce(F.get(at, k + 1) - p, F.lit(window)), F.lit(window))),
        F.lit(0).cast("bigint"), lambda a, x: a + x,
    )
    return (
        df.withColumn("_words", F.transform(w, lambda x: F.xxhash64(x)))
        .withColumn("_hashes", F.when(F.size(g) > window, hashes))
        .withColumn("_packed", F.when(some & (F.size(h) < size), packed))
        .withColumn("_sorted", F.when(some, ordered))
        .withColumn("_at", F.when(s.isNotNull(), F.sort_array(F.transform(same, lambda x: x["i"]))))
        .withColumn(name, F.when(at.isNotNull(), covered).otherwise(F.lit(0)).cast("long"))
        .drop("_words", "_hashes", "_packed", "_sorted", "_at")
    )


def document_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, and
    ``line_entries``: hash and words of each line."""
    t = F.coalesce(F.col(text), F.lit(""))
    flat = F.replace(_spaced(t), F.lit("\n"), F.lit(" "))
    entries = F.col("line_entries")
    out = (
        docs.withColumn("_tokens", F.array_remove(F.split(flat, " "), ""))
        .withColumn("n_words", F.size("_tokens").cast("long"))
        .withColumn("_lines", F.split(t, "\n"))
        .withColumn("line_entries", line_entries(F.col("_lines")))
        .withColumn("word_chars", F.aggregate(entries, F.lit(0).cast("bigint"), lambda a, e: a + e["c"]))
        .withColumn("n_symbols", (F.char_length(t) - F.char_length(F.regexp_replace(t, SYMBOLS, ""))).cast("long"))
        .withColumn("n_dup_lines", (F.size(entries) - F.size(F.array_distinct(entries["r"]))).cast("long"))
    )
    return with_repeated_words(out, "_tokens", "n_repeat_words").withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS)
        | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")),
    ).drop("_tokens", "_lines")


def _removed_lines(counted: DataFrame) -> DataFrame:
    """``(host, h)`` of the lines to remove."""
    seen = counted.select(
        "host", "text_hash", F.explode(F.array_distinct(F.col("line_entries.h"))).alias("h")
    )
    # Copies fall together in the partial count, before anything moves.
    lines = seen.groupBy("host", "h").agg(F.count_distinct("text_hash").alias("n")).filter(F.col("n") > LINE_DOCS)
    hosts = counted.groupBy("host").agg(F.count_distinct("text_hash").alias("docs"))
    return (
        lines.join(hosts, "host")
        .filter(100 * F.col("n") > LINE_PERCENT * F.col("docs"))
        .select("host", "h")
    )


def _hits(counted: DataFrame, lines: DataFrame) -> DataFrame:
    """``(row, line_chars, removed)`` of the rows that hold one of ``lines (host, h)``."""
    salted = lines.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return (
        counted.select("row", "host", F.explode("line_entries").alias("e"))
        .select("row", "host", "e.h", "e.c", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int").alias("salt"))
        .join(salted, ["host", "h", "salt"])
        .groupBy("row")
        .agg(F.sum("c").alias("line_chars"), F.collect_set("h").alias("removed"))
    )


def _kept() -> Column:
    left = F.col("word_chars") - F.col("line_chars")
    return ~F.col("base_failed") & (100 * left >= KEPT_PERCENT * F.col("word_chars"))


def verdicts(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Counts, ``line_chars`` (word characters in removed lines), ``kept`` and ``removed`` per row.

    ``removed`` lists the hashes of the row's lines to remove. One pass over the texts; the
    rest reads the written table of counts and line hashes.
    """
    base = docs.select(
        F.col(key).alias("key"), F.col(text).alias("text"),
        F.coalesce(F.concat(F.lit("="), F.col(host)), F.lit("-")).alias("host"),
        F.xxhash64(F.col(text)).alias("text_hash"),
    )
    counted = written(
        document_counts(base).drop("text").withColumn("row", F.monotonically_increasing_id()), "line-hashes"
    )
    return (
        counted.drop("line_entries", "host")
        .join(_hits(counted, _removed_lines(counted)), "row", "left")
        .withColumn("line_chars", F.coalesce("line_chars", F.lit(0)).cast("long"))
        .withColumn("kept", _kept())
        .drop("row")
    )


def _without(text: Column, removed: Column) -> Column:
    """The text without the lines whose hashes are in ``removed``."""
    lines = F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(removed, line_hash(x)))
    return F.when(F.size(removed) == 0, text).otherwise(F.array_join(lines, "\n"))


def apply_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """The kept rows of ``docs``, without the removed lines; all columns stay.

    Rows are written once with their counts. A host's list of lines to remove is short, since
    each stands in more than ``LINE_PERCENT`` of its documents: the lists are broadcast if
    their bytes allow it, and every row is settled where it stands. Otherwise only rows that
    something happens to are looked up, by row number.
    """
    base = docs.select(
        F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("_doc"),
        F.col(text).alias("text"),
        F.coalesce(F.concat(F.lit("="), F.col(host)), F.lit("-")).alias("host"),
        F.xxhash64(F.col(text)).alias("text_hash"),
    )
    counted = written(
        document_counts(base).drop("text").withColumn("row", F.monotonically_increasing_id()), "counted-documents"
    )
    lines = written(_removed_lines(counted).groupBy("host").agg(F.collect_list("h").alias("_lines")), "removed-lines")
    size = lines.agg(F.sum(F.size("_lines") * 8 + F.octet_length("host")).alias("b"), F.max(F.size("_lines")).alias("n")).first()
    none = F.array().cast("array<bigint>")
    if (size["b"] or 0) <= LIST_BYTES and (size["n"] or 0) <= LIST_LINES:
        settled = counted.join(F.broadcast(lines), "host", "left").withColumn("_lines", F.coalesce("_lines", none))
        gone = F.filter("line_entries", lambda e: F.array_contains("_lines", e["h"]))
        settled = settled.withColumn("_gone", gone).withColumns({
            "line_chars": F.aggregate("_gone", F.lit(0).cast("bigint"), lambda a, e: a + e["c"]), "removed": F.col("_gone.h"),
        })
    else:
        hits = _hits(counted, lines.select("host", F.explode("_lines").alias("h")))
        settled = counted.join(hits, "row", "left").withColumns({
            "line_chars": F.coalesce("line_chars", F.lit(0).cast("long")), "removed": F.coalesce("removed", none),
        })
    at = docs.columns.index(text)
    return settled.filter(_kept()).select(*[
        (_without(F.col(f"_doc.c{i}"), F.col("removed")) if i == at else F.col(f"_doc.c{i}")).alias(c)
        for i, c in enumerate(docs.columns)
    ])


_WORDS = r"list_filter(regexp_split_to_array(replace(coalesce(text, ''), chr(11), ' '), '[ \t\n\f\r]+'), lambda w: w <> '')"
_LINE = r"regexp_replace(l, '[ \t\f\r]', '', 'g')"
SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce('=' || source, '-') AS host, coalesce(text, '') AS text, {_WORDS} AS w,
    list_filter(string_split(replace(coalesce(text, ''), chr(11), ' '), chr(10)), lambda l: {_LINE} <> '') AS lines
  FROM documents),
win AS (SELECT doc_id, i, w[i:i + 2] AS g FROM d, unnest(generate_series(1, len(w) - 2)) AS u(i)),
rep AS (SELECT doc_id, g FROM win GROUP BY ALL HAVING count(*) > 1),
cov AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM (SELECT win.doc_id, i FROM win JOIN rep ON win.doc_id = rep.doc_id AND win.g = rep.g), unnest([0, 1, 2]) AS v(k)
  GROUP BY doc_id),
ent AS (
  SELECT doc_id, host, text, lower({_LINE}) AS h, length({_LINE}) AS n
  FROM d, unnest(lines) AS u(l)),
hosts AS (SELECT host, count(DISTINCT text) AS docs FROM d GROUP BY host),
bad AS (
  SELECT host, h FROM (SELECT host, h, count(DISTINCT text) AS n FROM ent GROUP BY ALL) JOIN hosts USING (host)
  WHERE n > {LINE_DOCS} AND 100 * n > {LINE_PERCENT} * docs),
hit AS (SELECT doc_id, sum(n) AS line_chars FROM ent JOIN bad USING (host, h) GROUP BY doc_id),
c AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, list_sum(list_transform(w, lambda x: length(x)))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(line_chars, 0)::BIGINT AS line_chars
  FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN hit USING (doc_id)),
b AS (SELECT * REPLACE (coalesce(word_chars, 0) AS word_chars), n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, line_chars,
  NOT base_failed AND 100 * (word_chars - line_chars) >= {KEPT_PERCENT} * word_chars AS kept
FROM b
"""


@query("op2_quality_rules", SQL)
def op2(spark, sf):
    """Counts and verdict of every document."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text")
    return verdicts(docs).select(
        F.col("key").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "line_chars", "kept",
    )

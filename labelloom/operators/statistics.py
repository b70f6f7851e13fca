"""Corpus and label statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.operators.keyed import running_count
from labelloom.operators.lookup import lookup
from labelloom.operators.vocabulary import term_counts
from labelloom.storage import written


def counts_by(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    """Rows per value, most frequent first."""
    return df.groupBy(column).agg(F.count("*").alias(name)).orderBy(F.desc(name), column)


def counts_by_text(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    """``counts_by`` for long texts: grouped by digest and length, one text carried along."""
    same = df.groupBy(F.md5(column).alias("_d"), F.octet_length(column).alias("_l"))
    counts = same.agg(F.any_value(column).alias(column), F.count("*").alias(name))
    return counts.drop("_d", "_l").orderBy(F.desc(name), column)


def corpus_stats(df: DataFrame, label: str, words: str) -> DataFrame:
    """One row: documents, documents per class as map, words, distinct words, mean length.

    Words are cut once: a row gives an entry for itself and one per distinct word.
    """
    own = F.struct(F.col(label).alias("l"), F.lit(None).cast("string").alias("w"), F.size(words).cast("long").alias("n"))
    none = F.lit(None).cast(df.schema[label].dataType)
    each = F.transform(
        F.array_distinct(words), lambda w: F.struct(none.alias("l"), w.alias("w"), F.lit(None).cast("long").alias("n"))
    )
    entries = df.select(F.inline_outer(F.concat(F.array(own), each)))
    seen = written(
        entries.groupBy("l", "w").agg(F.count("n").alias("docs"), F.sum("n").alias("words")), "corpus-counts"
    )
    classes = seen.filter("w is null")
    vocabulary = seen.filter("w is not null").agg(F.count("*").alias("v")).scalar()
    return classes.agg(
        F.sum("docs").alias("documents"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("l"), "docs")))).alias("per_class"),
        F.sum("words").alias("words"),
        (F.sum("words") / F.sum("docs")).alias("mean_words"),
    ).withColumn("vocabulary", vocabulary)


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """``(bin, low, high, n)``: equal-width bins from minimum to maximum, empty ones too.

    The maximum belongs to the last bin. When all values are equal the range is widened by
    one half on both sides.
    """
    # One pass over the input; equal values are counted together.
    values = written(
        df.groupBy(F.col(column).cast("double").alias("x")).agg(F.count("*").alias("n")),
        "values",
    ).filter(F.col("x").isNotNull())
    limits = values.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    flat = F.col("hi") == F.col("lo")
    limits = limits.select(
        F.struct(
            F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
            F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
        ).alias("l")
    )
    width = (F.col("_l.hi") - F.col("_l.lo")) / bins
    placed = (
        values.withColumn("_l", limits.scalar())
        .select(
            F.least(F.floor((F.col("x") - F.col("_l.lo")) / width), F.lit(bins - 1))
            .cast("int").alias("bin"),
            "n",
        )
        .groupBy("bin").agg(F.sum("n").alias("n"))
    )
    frame = limits.select(
        F.col("l").alias("_l"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    )
    # Both sides have at most ``bins`` rows.
    return frame.join(F.broadcast(placed), "bin", "left").select(
        "bin",
        (F.col("_l.lo") + F.col("bin") * width).alias("low"),
        (F.col("_l.lo") + (F.col("bin") + 1) * width).alias("high"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def term_cloud(df: DataFrame, tokens: str, size: int = 200) -> DataFrame:
    """``(term, n, weight)`` of the most frequent terms, weight 1 for the first."""
    top = (
        term_counts(df, tokens).groupBy("term")
        .agg(F.sum("tf").alias("n")).orderBy(F.desc("n"), "term").limit(size)
    )
    best = F.element_at(F.col("_all.n"), 1)
    # At most ``size`` entries in the array.
    return (
        top.agg(F.sort_array(F.collect_list(F.struct("n", "term")), asc=False).alias("_all"))
        .select(best.alias("_best"), F.explode("_all").alias("_e"))
        .select(F.col("_e.term").alias("term"), F.col("_e.n").alias("n"),
                (F.col("_e.n") / F.col("_best")).alias("weight"))
    )


def value_ranks(df: DataFrame, group: str, value: str) -> DataFrame:
    """Written ``(group, _x, _n, _upto, _total)``: distinct values, their rows, rows up to them.

    Equal values are counted together first; the distinct ones are ranked over value
    ranges, so a group of any size is spread over many tasks. Reads the input once.
    """
    filled = df.filter(F.col(value).isNotNull())
    values = written(
        filled.groupBy(group, F.col(value).cast("double").alias("_x")).agg(F.count("*").alias("_n")), "values"
    )
    return written(running_count(values, "_x", "_n", [group], "_upto"), "value-ranks")


def _quantiles(ranked: DataFrame, group: str, shares: tuple[float, ...]) -> DataFrame:
    first = F.col("_upto") - F.col("_n")
    positions = F.array(
        *[
            F.struct(F.lit(s).alias("q"), (F.lit(s) * (F.col("_total") - 1)).alias("pos"))
            for s in shares
        ]
    )
    # A share needs the values at the positions just below and just above it.
    hit = F.filter(
        positions,
        lambda e: (F.floor(e["pos"]) < F.col("_upto")) & (F.ceil(e["pos"]) >= first),
    )
    hits = ranked.select(
        group, "_x", "_upto", first.alias("_first"), F.explode(hit).alias("_p")
    ).select(
        group, "_x", F.col("_p.q").alias("q"), F.col("_p.pos").alias("_pos"),
        (F.floor("_p.pos") >= F.col("_first")).alias("_low"),
        (F.ceil("_p.pos") < F.col("_upto")).alias("_high"),
    )
    low = F.max(F.when(F.col("_low"), F.col("_x")))
    high = F.max(F.when(F.col("_high"), F.col("_x")))
    part = F.max("_pos") - F.floor(F.max("_pos"))
    return hits.groupBy(group, "q").agg((low + (high - low) * part).alias("value"))


def group_quantiles(
    df: DataFrame, group: str, value: str, shares: tuple[float, ...] = (0.25, 0.5, 0.75)
) -> DataFrame:
    """``(group, q, value)``: exact, linearly interpolated quantiles per group."""
    return _quantiles(value_ranks(df, group, value), group, shares)


def box_plot(df: DataFrame, group: str, value: str) -> DataFrame:
    """Quartiles, extremes, whiskers within 1.5 IQR and the number of outliers per group.

    Everything is read from one table of ranked values.
    """
    ranked = value_ranks(df, group, value)
    quartiles = _quantiles(ranked, group, (0.25, 0.5, 0.75)).groupBy(group).agg(
        *[F.max(F.when(F.col("q") == q, F.col("value"))).alias(name) for q, name in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))]
    )
    spread = F.col("q3") - F.col("q1")
    inside = F.col("_x").between(F.col("q1") - 1.5 * spread, F.col("q3") + 1.5 * spread)
    uses = ranked.groupBy(group).agg(F.count("*").alias("_uses"))
    table = written(quartiles.join(uses, group), "quartiles")
    kind = df.schema[value].dataType
    return (
        lookup(ranked, table, group, "_x", "_uses").groupBy(group, "q1", "median", "q3")
        .agg(
            F.max("_total").alias("n"), F.min("_x").alias("lowest"), F.max("_x").alias("highest"),
            F.min(F.when(inside, F.col("_x"))).alias("whisker_low"), F.max(F.when(inside, F.col("_x"))).alias("whisker_high"),
            F.coalesce(F.sum(F.when(~inside, F.col("_n"))), F.lit(0)).alias("outliers"),
        )
        .withColumns({c: F.col(c).cast(kind) for c in ("lowest", "highest", "whisker_low", "whisker_high")})
    )


def mean_by(df: DataFrame, group: str, value: str, name: str) -> DataFrame:
    return df.groupBy(group).agg(F.avg(value).alias(name))


def scalar_count(df: DataFrame) -> Column:
    return df.agg(F.count("*").alias("n")).scalar()

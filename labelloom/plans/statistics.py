"""Corpus, label and metric statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloom.functions import text as T
from labelloom.operators import labels, statistics, vectors
from labelloom.plans import tables as t
from labelloom.plans.registry import query


@query("agg_label_counts", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def agg_label_counts(spark, sf):
    return statistics.counts_by(t.table(spark, sf, "documents"), "lang")


@query("agg_duplicate_text", "SELECT text, count(*) AS n FROM documents GROUP BY text")
def agg_duplicate_text(spark, sf):
    return statistics.counts_by_text(t.table(spark, sf, "documents"), "text")


@query(
    "agg_label_nonnull",
    "SELECT lang, count(CASE WHEN n_chars > 1000 THEN text END) AS n FROM documents GROUP BY lang",
)
def agg_label_nonnull(spark, sf):
    rows = t.table(spark, sf, "documents").select(
        "lang", F.when(F.col("n_chars") > 1000, F.col("text")).alias("content")
    )
    return rows.groupBy("lang").agg(F.count("content").alias("n"))


@query(
    "agg_label_dim",
    "SELECT source, CAST(row_number() OVER (ORDER BY min(doc_id)) - 1 AS INTEGER) AS label_id "
    "FROM documents GROUP BY source ORDER BY label_id",
)
def agg_label_dim(spark, sf):
    ids = labels.first_seen_ids(t.table(spark, sf, "documents"), "source", "doc_id")
    return ids.drop("rows").orderBy("label_id")


@query(
    "agg_doc_words",
    "SELECT doc_id, CAST(len(a) AS INTEGER) AS n_words, CAST(len(b) AS INTEGER) AS n_with_blank "
    f"FROM (SELECT doc_id, {t.sql_review_words('text')} AS a, "
    f"{t.sql_review_words('text', True)} AS b FROM documents)",
)
def agg_doc_words(spark, sf):
    """Words per file, without and with the empty word of a blank line."""
    return t.table(spark, sf, "documents").select(
        "doc_id", F.size(T.review_words(F.col("text"))).alias("n_words"),
        F.size(T.review_words(F.col("text"), faithful=True)).alias("n_with_blank"),
    )


def _reviews(spark, sf):
    return t.review_tokens(spark, sf).join(
        t.table(spark, sf, "labels").select("doc_id", "quality"), "doc_id"
    )


@query(
    "agg_corpus_stats",
    f"WITH r AS (SELECT quality, tokens FROM ({t.SQL_REVIEW}) JOIN labels USING (doc_id)) "
    "SELECT count(*) AS documents, count(*) FILTER (quality = 1) AS truthful, "
    "count(*) FILTER (quality = 0) AS deceptive, CAST(sum(len(tokens)) AS BIGINT) AS words, "
    "(SELECT count(DISTINCT w) FROM (SELECT unnest(tokens) AS w FROM r)) AS vocabulary, "
    "round(avg(len(tokens)), 6) AS mean_words FROM r",
)
def agg_corpus_stats(spark, sf):
    stats = statistics.corpus_stats(_reviews(spark, sf), "quality", "tokens")
    return stats.select(
        "documents", F.col("per_class")[1].alias("truthful"), F.col("per_class")[0].alias("deceptive"),
        "words", "vocabulary", t.rounded("mean_words").alias("mean_words"),
    )


@query(
    "agg_histogram",
    f"WITH x AS (SELECT len(tokens)::DOUBLE AS x FROM ({t.SQL_REVIEW})), "
    "l AS (SELECT min(x) AS lo, (max(x) - min(x)) / 50 AS w FROM x), "
    "c AS (SELECT least(floor((x - lo) / w), 49) AS bin, count(*) AS n FROM x, l GROUP BY 1) "
    "SELECT CAST(b AS INTEGER) AS bin, round(lo + b * w, 6) AS low, "
    "round(lo + (b + 1) * w, 6) AS high, coalesce(n, 0) AS n "
    "FROM range(50) r(b) CROSS JOIN l LEFT JOIN c ON c.bin = r.b",
)
def agg_histogram(spark, sf):
    lengths = t.review_tokens(spark, sf).select(F.size("tokens").alias("n_words"))
    bins = statistics.histogram(lengths, "n_words", 50)
    return bins.withColumn("low", t.rounded("low")).withColumn("high", t.rounded("high"))


@query(
    "agg_term_weights",
    "WITH c AS (SELECT term, count(*) AS n FROM (SELECT unnest(tokens) AS term FROM "
    f"({t.SQL_WORDS})) GROUP BY term ORDER BY n DESC, term LIMIT 200) "
    "SELECT term, n, round(n / (SELECT max(n) FROM c)::DOUBLE, 6) AS weight FROM c",
)
def agg_term_weights(spark, sf):
    return statistics.term_cloud(t.words(spark, sf), "tokens").withColumn(
        "weight", t.rounded("weight")
    )


_METRICS = "SELECT event_type AS model_name, event_id % 5 AS fold_idx, value AS accuracy FROM events"


def _metrics(spark, sf):
    return t.table(spark, sf, "events").select(
        F.col("event_type").alias("model_name"), (F.col("event_id") % 5).alias("fold_idx"),
        F.col("value").alias("accuracy"),
    )


@query(
    "agg_model_mean",
    f"SELECT model_name, round(avg(accuracy), 6) AS accuracy FROM ({_METRICS}) GROUP BY model_name",
)
def agg_model_mean(spark, sf):
    return statistics.mean_by(
        _metrics(spark, sf), "model_name", "accuracy", "accuracy"
    ).withColumn("accuracy", t.rounded("accuracy"))


@query(
    "agg_model_boxplot",
    f"WITH m AS ({_METRICS}), q AS (SELECT model_name, quantile_cont(accuracy, 0.25) AS q1, "
    "quantile_cont(accuracy, 0.5) AS median, quantile_cont(accuracy, 0.75) AS q3, count(*) AS n "
    "FROM m GROUP BY model_name), "
    "r AS (SELECT *, accuracy BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1) "
    "AS inside FROM m JOIN q USING (model_name)) "
    "SELECT model_name, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, n, "
    "round(min(accuracy), 6) AS lowest, round(max(accuracy), 6) AS highest, "
    "round(min(accuracy) FILTER (inside), 6) AS whisker_low, "
    "round(max(accuracy) FILTER (inside), 6) AS whisker_high, "
    "count(*) FILTER (NOT inside) AS outliers FROM r GROUP BY ALL",
)
def agg_model_boxplot(spark, sf):
    box = statistics.box_plot(_metrics(spark, sf), "model_name", "accuracy")
    numbers = ["q1", "median", "q3", "lowest", "highest", "whisker_low", "whisker_high"]
    return box.select(
        "model_name", "n", "outliers", *[t.rounded(c).alias(c) for c in numbers]
    )


_MEAN_SQL = (
    "SELECT label, CAST(d - 1 AS INTEGER) AS idx, round(avg(x), 6) AS value FROM "
    "(SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS d "
    "FROM embeddings) GROUP BY label, d"
)


def _mean_params(spark, sf):
    means = vectors.mean_by_key(t.table(spark, sf, "embeddings"), "label", "embedding")
    return means.select("label", F.posexplode("embedding").alias("idx", "value")).withColumn(
        "value", t.rounded("value")
    )


@query("agg_mean_params", _MEAN_SQL)
def agg_mean_params(spark, sf):
    """Element-wise mean of the arrays of each key."""
    return _mean_params(spark, sf)


@query("udf_reducer", _MEAN_SQL)
def udf_reducer(spark, sf):
    """A Python reducer over weights becomes the built-in average."""
    return _mean_params(spark, sf)

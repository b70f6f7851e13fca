"""Source and sink queries: rows are written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloom.functions import text as T
from labelloom.operators import splits, vectors, vocabulary
from labelloom.plans import tables as t
from labelloom.plans.registry import query
from labelloom.sources import readers, writers
from labelloom.storage import new_path


@query("src_csv_headered", t.SQL_TWEETS)
def src_csv_headered(spark, sf):
    path = new_path(spark, "tweets-csv")
    writers.write_csv(t.tweets(spark, sf), path)
    return readers.read_labelled_csv(spark, path, multi_line=True)


_SOME_NULL = (
    "SELECT doc_id AS tweet_id, lang AS sentiment, source AS author, "
    "CASE WHEN lang = 'fr' THEN NULL ELSE text END AS content FROM documents"
)


def _some_null(spark, sf):
    return t.tweets(spark, sf).withColumn(
        "content", F.when(F.col("sentiment") != "fr", F.col("content"))
    )


@query("src_csv_notnull", f"SELECT * FROM ({_SOME_NULL}) WHERE content IS NOT NULL AND content <> ''")
def src_csv_notnull(spark, sf):
    path = new_path(spark, "tweets-csv")
    writers.write_csv(_some_null(spark, sf), path)
    return readers.read_labelled_csv_not_null(spark, path, multi_line=True)


@query("flt_not_null", f"SELECT * FROM ({_SOME_NULL}) WHERE content IS NOT NULL")
def flt_not_null(spark, sf):
    return _some_null(spark, sf).filter(F.col("content").isNotNull())


_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
# Class numbers of the three return flags.
_FLAGS = {"A": 0, "N": 1, "R": 2}


def numeric_rows(spark, sf):
    """Four numeric features and a class number, the label last."""
    flag = F.create_map(*[F.lit(x) for pair in _FLAGS.items() for x in pair])
    return t.table(spark, sf, "lineitem").select(
        *_FEATURES, flag[F.col("l_returnflag")].cast("long").alias("label")
    )


SQL_NUMERIC = (
    f"SELECT {', '.join(_FEATURES)}, CAST(CASE l_returnflag "
    + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _FLAGS.items())
    + " END AS BIGINT) AS label FROM lineitem"
)


@query("src_csv_lines", SQL_NUMERIC)
def src_csv_lines(spark, sf):
    path = new_path(spark, "numbers-csv")
    numeric_rows(spark, sf).write.csv(path)
    return readers.read_numeric_lines(spark, path, _FEATURES)


@query(
    "prj_split_xy",
    "SELECT l_quantity AS x1, l_extendedprice AS x2, l_discount AS x3, l_tax AS x4, label AS y "
    f"FROM ({SQL_NUMERIC})",
)
def prj_split_xy(spark, sf):
    pairs = readers.split_features(numeric_rows(spark, sf))
    return pairs.select(
        *[F.element_at("features", i).alias(f"x{i}") for i in range(1, 5)],
        F.col("label").alias("y"),
    )


@query(
    "src_labelled_files",
    "SELECT l.doc_id, CASE WHEN l.quality = 1 THEN 'truthful' ELSE 'deceptive' END AS label, "
    "CAST(length(d.text) + 1 AS INTEGER) AS n_chars, md5(d.text || chr(10)) AS body "
    "FROM labels l JOIN documents d USING (doc_id)",
)
def src_labelled_files(spark, sf):
    """One file per document in a folder of its own below its label's root, read back with the root's label."""
    label = F.when(F.col("quality") == 1, "truthful").otherwise("deceptive")
    rows = (
        t.table(spark, sf, "labels").join(t.table(spark, sf, "documents"), "doc_id")
        .select(label.alias("root"), "doc_id", "text")
    )
    path = new_path(spark, "reviews")
    writers.write_labelled_files(rows, path, "root", "doc_id")
    files = readers.read_labelled_files(
        spark,
        {"truthful": [f"{path}/root=truthful"], "deceptive": [f"{path}/root=deceptive"]},
    )
    return files.select(
        F.regexp_extract("path", r"doc_id=(-?\d+)/", 1).cast("long").alias("doc_id"),
        "label", F.length("text").alias("n_chars"), F.md5("text").alias("body"),
    )


_VECTOR_ENTRIES = (
    "SELECT vec_id, unnest(embedding) AS value, generate_subscripts(embedding, 1) AS d "
    "FROM embeddings"
)


@query(
    "src_word_vectors",
    "SELECT concat('w', vec_id) AS word, CAST(d - 1 AS INTEGER) AS dim, "
    f"round(CAST(value AS DOUBLE), 6) AS value FROM ({_VECTOR_ENTRIES})",
)
def src_word_vectors(spark, sf):
    path = new_path(spark, "vectors-text")
    lines = t.table(spark, sf, "embeddings").select(
        F.concat_ws(" ", F.concat(F.lit("w"), "vec_id"), t.joined("embedding")).alias("value")
    )
    lines.write.text(path)
    return readers.read_word_vectors(spark, path).select(
        "word", F.posexplode("vector").alias("dim", "value")
    ).withColumn("value", t.rounded(F.col("value").cast("double")))


# Sentences scored by hand.
SENTENCES = [
    "This movie is so damn boring.",
    "That is so sad.",
    "I cannot get proper sleep.",
    "I am so happy about the results.",
    "Filthy people.",
]
SQL_SENTENCES = "SELECT * FROM (VALUES " + ", ".join(
    f"(CAST({i} AS BIGINT), {t.quoted(s)})" for i, s in enumerate(SENTENCES)
) + ") AS s(id, content)"


@query(
    "src_inline_rows",
    f"WITH w AS (SELECT DISTINCT id, content, unnest({t.sql_word_tokens('content')}) AS word "
    f"FROM ({SQL_SENTENCES})), "
    f"df AS (SELECT word, count(DISTINCT doc_id) AS n FROM (SELECT doc_id, unnest(tokens) AS word "
    f"FROM ({t.SQL_WORDS})) GROUP BY word) "
    "SELECT id, content, word, coalesce(n, 0) AS documents FROM w LEFT JOIN df USING (word)",
)
def src_inline_rows(spark, sf):
    """Words of literal sentences with the number of documents that use them."""
    inline = readers.inline_rows(spark, SENTENCES).withColumnRenamed("doc_id", "id")
    asked = inline.select(
        "id", "content", F.explode(F.array_distinct(T.word_tokens(F.col("content")))).alias("word")
    )
    # The sentences are a fixed handful of words; other words are dropped before counting.
    found = t.words(spark, sf).select(F.explode(F.array_distinct("tokens")).alias("word"))
    used = (
        found.join(F.broadcast(asked.select("word")), "word", "left_semi")
        .groupBy("word").agg(F.count("*").alias("df"))
    )
    return used.join(F.broadcast(asked), "word", "right").select(
        "id", "content", "word", F.coalesce("df", F.lit(0)).alias("documents")
    )


def word_vectors(spark, sf, words):
    """Vectors for the vocabulary: the word with id k has the embedding with ``vec_id`` k."""
    embeddings = t.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("word_id"), F.col("embedding").alias("vector")
    )
    return words.select("word", "word_id").join(embeddings, "word_id").select("word", "vector")


@query(
    "sink_vocab",
    f"SELECT word, word_id, e.vec_id IS NOT NULL AS known FROM ({t.sql_vocabulary(t.SQL_REVIEW)}) "
    "LEFT JOIN embeddings e ON e.vec_id = word_id",
)
def sink_vocab(spark, sf):
    words = vocabulary.distinct_words(t.review_tokens(spark, sf), "tokens")
    known = word_vectors(spark, sf, words)
    path = new_path(spark, "vocabulary")
    writers.write_vocabulary(path, words, known, vectors.unknown_words(words, known))
    words, known, unknown = writers.read_vocabulary(spark, path)
    return (
        words.join(known.select("word", F.lit(True).alias("_known")), "word", "left")
        .join(unknown.select("word", F.lit(False).alias("_unknown")), "word", "left")
        .select("word", "word_id", F.coalesce("_known", "_unknown").alias("known"))
    )


@query(
    "sink_split",
    "WITH r AS (SELECT doc_id, quality, row_number() OVER (ORDER BY "
    f"{t.sql_hash('doc_id', 0)}, doc_id) AS rn, count(*) OVER () AS n FROM labels) "
    "SELECT doc_id, quality FROM r WHERE rn <= floor(n * CAST(0.1 AS DOUBLE))",
)
def sink_split(spark, sf):
    parts = splits.split_exact_three(
        t.table(spark, sf, "labels").select("doc_id", "quality"), "doc_id"
    )
    path = new_path(spark, "split")
    writers.write_split(parts, path)
    return writers.read_split(spark, path, "test")


@query(
    "sink_metrics",
    "SELECT event_id AS step, event_type AS series, value AS loss, "
    "CAST(event_id % 2 AS DOUBLE) AS accuracy, 'run-1' AS run_id FROM events",
)
def sink_metrics(spark, sf):
    metrics = t.table(spark, sf, "events").select(
        F.col("event_id").alias("step"), F.col("event_type").alias("series"),
        F.col("value").alias("loss"), (F.col("event_id") % 2).cast("double").alias("accuracy"),
    )
    path = new_path(spark, "metrics")
    half = F.col("step") % 2
    writers.append_metrics(metrics.filter(half == 0), path, "run-1")
    writers.append_metrics(metrics.filter(half == 1), path, "run-1")
    return writers.read_metrics(spark, path).select("step", "series", "loss", "accuracy", "run_id")


@query("out_preview", f"SELECT * FROM ({t.SQL_TWEETS}) ORDER BY tweet_id LIMIT 5")
def out_preview(spark, sf):
    return writers.preview(t.tweets(spark, sf), "tweet_id", 5)


@query("limit_n", f"SELECT sentiment, content FROM ({t.SQL_TWEETS}) ORDER BY tweet_id LIMIT 10")
def limit_n(spark, sf):
    return t.tweets(spark, sf).orderBy("tweet_id").limit(10).select("sentiment", "content")


@query("prj_drop_list", f"SELECT sentiment, content FROM ({t.SQL_TWEETS})")
def prj_drop_list(spark, sf):
    return readers.drop_columns(t.tweets(spark, sf), ["tweet_id", "author"])


@query("prj_select_rename", f"SELECT sentiment AS mood, content AS text FROM ({t.SQL_TWEETS})")
def prj_select_rename(spark, sf):
    return readers.select_renamed(
        t.tweets(spark, sf), ["sentiment", "content"], ["mood", "text"]
    )

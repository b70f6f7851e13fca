"""Label dictionary, one-hot and lookup queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloom.functions import arrays as A
from labelloom.operators import evaluation, labels, vocabulary
from labelloom.operators import vectors as V
from labelloom.plans import tables as t
from labelloom.plans.registry import query
from labelloom.plans.tables_io import word_vectors
from labelloom.storage import written

_SOURCE_IDS = (
    "SELECT author, CAST(row_number() OVER (ORDER BY first_id) - 1 AS INTEGER) AS label_id FROM "
    f"(SELECT author, min(tweet_id) AS first_id FROM ({t.SQL_TWEETS}) GROUP BY author)"
)


@query("lbl_first_seen_id", _SOURCE_IDS)
def lbl_first_seen_id(spark, sf):
    return labels.first_seen_ids(t.tweets(spark, sf), "author", "tweet_id").drop("rows")


@query(
    "lbl_frequency_id",
    "SELECT tweet_id, sentiment, CAST(i AS DOUBLE) AS label FROM "
    f"({t.SQL_TWEETS}) JOIN (SELECT sentiment, row_number() OVER (ORDER BY count(*) DESC, "
    f"sentiment) - 1 AS i FROM ({t.SQL_TWEETS}) GROUP BY sentiment) USING (sentiment)",
)
def lbl_frequency_id(spark, sf):
    rows = t.tweets(spark, sf).select("tweet_id", "sentiment")
    return labels.frequency_ids(rows, "sentiment").transform(rows)


@query(
    "lbl_from_id",
    f"SELECT tweet_id, label_id, author FROM ({t.SQL_TWEETS}) JOIN ({_SOURCE_IDS}) USING (author)",
)
def lbl_from_id(spark, sf):
    rows = t.tweets(spark, sf).select("tweet_id", "author")
    ids = labels.first_seen_ids(rows, "author", "tweet_id")
    coded = labels.with_label_id(rows, ids, "author", "tweet_id").drop("author")
    return labels.with_label_name(coded, ids, "label_id", "tweet_id").select(
        "tweet_id", "label_id", "author"
    )


@query(
    "lbl_one_hot_binary",
    "SELECT doc_id, CASE WHEN quality = 1 THEN '1 0' ELSE '0 1' END AS target FROM labels",
)
def lbl_one_hot_binary(spark, sf):
    return t.table(spark, sf, "labels").select(
        "doc_id", t.joined(A.one_hot_binary(F.col("quality") == 1)).alias("target")
    )


@query(
    "lbl_one_hot_multi",
    "WITH c AS (SELECT list(DISTINCT lang ORDER BY lang) AS classes FROM documents) "
    "SELECT doc_id, array_to_string(list_transform((SELECT classes FROM c), "
    "lambda k: CASE WHEN k = lang THEN 1 ELSE 0 END), ' ') AS target FROM documents",
)
def lbl_one_hot_multi(spark, sf):
    rows = t.table(spark, sf, "documents").select("doc_id", "lang")
    return labels.with_one_hot(rows, "lang", "target").select(
        "doc_id", t.joined("target").alias("target")
    )


@query("flt_predicted_class", f"SELECT * FROM ({t.SQL_MARKED}) WHERE predicted = 0")
def flt_predicted_class(spark, sf):
    return t.marked(spark, sf).filter(F.col("predicted") == 0)


@query(
    "join_misclassified",
    f"SELECT doc_id, actual, predicted, text FROM ({t.SQL_MARKED}) "
    "JOIN documents USING (doc_id) WHERE actual <> predicted",
)
def join_misclassified(spark, sf):
    texts = t.table(spark, sf, "documents").select("doc_id", "text")
    return evaluation.misclassified(t.marked(spark, sf), texts, "doc_id", "actual", "predicted")


_ROLE_IDS = (
    "SELECT role, CAST(row_number() OVER (ORDER BY f) - 1 AS INTEGER) AS label_id FROM "
    "(SELECT role, min(conv_id * 100000 + turn) AS f FROM conversations GROUP BY role)"
)


@query(
    "join_label_names",
    f"SELECT label_id, role, count(*) AS turns FROM conversations JOIN ({_ROLE_IDS}) USING (role) "
    "GROUP BY label_id, role",
)
def join_label_names(spark, sf):
    """Counts by label id, with the name put back for the report."""
    rows = t.table(spark, sf, "conversations").select(
        "role", F.struct("conv_id", "turn").alias("key")
    )
    ids = labels.first_seen_ids(rows, "role", "key")
    coded = labels.with_label_id(rows, ids, "role", "key")
    counts = coded.groupBy("label_id").agg(F.count("*").alias("turns"))
    return labels.with_label_name(counts, ids, "label_id", "turns").select(
        "label_id", "role", "turns"
    )


_VOCABULARY = t.sql_vocabulary(t.SQL_REVIEW)


@query(
    "join_word_ids",
    "SELECT doc_id, count(*) AS tokens, CAST(sum(word_id) AS BIGINT) AS id_sum, "
    "min(word_id) AS id_min, max(word_id) AS id_max FROM "
    f"(SELECT doc_id, unnest(tokens) AS word FROM ({t.SQL_REVIEW})) "
    f"JOIN ({_VOCABULARY}) USING (word) GROUP BY doc_id",
)
def join_word_ids(spark, sf):
    # Cut into words once: the vocabulary and the join both read them.
    docs = written(t.review_tokens(spark, sf), "tokens")
    table = vocabulary.distinct_words(docs, "tokens")
    return vocabulary.id_summary(vocabulary.document_terms(docs, "tokens", "doc_id"), "doc_id", table)


@query(
    "join_word_vectors",
    "SELECT word, word_id, e.vec_id IS NOT NULL AS known, "
    "round(CAST(e.embedding[1] AS DOUBLE), 6) AS first_entry "
    f"FROM ({_VOCABULARY}) LEFT JOIN embeddings e ON e.vec_id = word_id",
)
def join_word_vectors(spark, sf):
    words = vocabulary.distinct_words(t.review_tokens(spark, sf), "tokens")
    known = word_vectors(spark, sf, words)
    return words.join(known, "word", "left").select(
        "word", "word_id", F.col("vector").isNotNull().alias("known"),
        t.rounded(F.element_at("vector", 1).cast("double")).alias("first_entry"),
    )


@query(
    "emb_unknown_words",
    f"SELECT word, word_id FROM ({_VOCABULARY}) "
    "WHERE word_id NOT IN (SELECT vec_id FROM embeddings)",
)
def emb_unknown_words(spark, sf):
    words = vocabulary.distinct_words(t.review_tokens(spark, sf), "tokens")
    return V.unknown_words(words, word_vectors(spark, sf, words)).select("word", "word_id")


@query(
    "join_label_pairs",
    "SELECT a.lang AS actual, b.lang AS predicted FROM (SELECT DISTINCT lang FROM documents) a, "
    "(SELECT DISTINCT lang FROM documents) b WHERE a.lang <> b.lang",
)
def join_label_pairs(spark, sf):
    return labels.class_pairs(t.table(spark, sf, "documents"), "lang", "actual", "predicted")


@query(
    "zip_by_key",
    "SELECT doc_id, lang, n_chars, quality FROM documents JOIN labels USING (doc_id)",
)
def zip_by_key(spark, sf):
    """Features and labels are paired by row key, not by position."""
    features = t.table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return features.join(t.table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")


@query(
    "union_corpora",
    "SELECT doc_id, CASE WHEN quality = 1 THEN 'truthful' ELSE 'deceptive' END AS label "
    "FROM labels",
)
def union_corpora(spark, sf):
    rows = t.table(spark, sf, "labels")
    truthful = rows.filter("quality = 1").select("doc_id", F.lit("truthful").alias("label"))
    deceptive = rows.filter("quality = 0").select("doc_id", F.lit("deceptive").alias("label"))
    return truthful.unionByName(deceptive)


@query("sort_labels", "SELECT DISTINCT lang FROM documents ORDER BY lang")
def sort_labels(spark, sf):
    return t.table(spark, sf, "documents").select("lang").distinct().orderBy("lang")


@query(
    "ml_argmax",
    "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS best "
    "FROM embeddings",
)
def ml_argmax(spark, sf):
    return t.table(spark, sf, "embeddings").select(
        "vec_id", A.argmax(F.col("embedding")).alias("best")
    )

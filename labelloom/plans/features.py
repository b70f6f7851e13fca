"""Vocabulary, bag-of-words, TF-IDF, chi-square, encoding and vector queries."""

from __future__ import annotations

from pyspark.ml.feature import HashingTF
from pyspark.sql import functions as F

from labelloom.functions import arrays as A
from labelloom.operators import splits, statistics, vectors, vocabulary, weights
from labelloom.plans import tables as t
from labelloom.plans.registry import query
from labelloom.plans.tables_io import word_vectors
from labelloom.storage import written

# Shape of an encoded review.
SENTENCES, WORDS_PER_SENTENCE = 16, 10
LENGTH = SENTENCES * WORDS_PER_SENTENCE

_VOCABULARY = t.sql_vocabulary(t.SQL_REVIEW)


@query("voc_distinct", f"SELECT word, uses, word_id FROM ({_VOCABULARY})")
def voc_distinct(spark, sf):
    return vocabulary.distinct_words(t.review_tokens(spark, sf), "tokens")


_TOP = (
    "SELECT word, uses, CAST(row_number() OVER (ORDER BY uses DESC, f) AS INTEGER) AS word_id FROM "
    "(SELECT word, count(*) AS uses, min((doc_id, p)) AS f FROM (SELECT doc_id, "
    "unnest(tokens) AS word, generate_subscripts(tokens, 1) AS p "
    f"FROM ({t.SQL_WORDS})) GROUP BY word) QUALIFY word_id <= 1999"
)


@query("voc_top_n", _TOP)
def voc_top_n(spark, sf):
    return vocabulary.top_words(t.words(spark, sf), "doc_id", "tokens")


_COUNTS = t.sql_counts(t.SQL_WORDS)
_FREQUENT = (
    f"SELECT term FROM ({_COUNTS}) GROUP BY term HAVING count(*) >= 5 "
    "ORDER BY sum(tf) DESC, term LIMIT 10000"
)


def word_counts(spark, sf):
    """Written term counts of each document: fitting and weighting both read them."""
    return written(vocabulary.document_terms(t.words(spark, sf), "tokens", "doc_id"), "document-terms")


@query(
    "vec_count",
    f"SELECT doc_id, term, tf FROM ({_COUNTS}) WHERE term IN ({_FREQUENT})",
)
def vec_count(spark, sf):
    docs = word_counts(spark, sf)
    return vocabulary.restrict(docs, vocabulary.frequent_terms(docs.select(F.inline("terms"))))


_SPLIT_SHARE = 0.75
_TRAIN = f"{t.sql_hash('doc_id', 100)} < '{int(_SPLIT_SHARE * 16**13):013x}'"


@query(
    "vec_count_all",
    f"WITH c AS ({_COUNTS}), v AS (SELECT DISTINCT term FROM c WHERE {_TRAIN}) "
    f"SELECT doc_id, CASE WHEN {_TRAIN} THEN 'train' ELSE 'test' END AS split, term, tf "
    "FROM c JOIN v USING (term)",
)
def vec_count_all(spark, sf):
    """Counts over all terms of the training part; other terms of the test part are unknown."""
    docs = splits.split_random(
        t.words(spark, sf), "doc_id", {"train": _SPLIT_SHARE, "test": 1 - _SPLIT_SHARE}
    )
    rows = written(vocabulary.document_terms(docs, "tokens", "doc_id", "split"), "document-terms")
    fitted = vocabulary.fit_terms(rows.filter(F.col("split") == "train").select(F.inline("terms")))
    return vocabulary.restrict(rows, fitted)


@query(
    "vec_hashing_tf",
    "SELECT doc_id, CAST(len(tokens) AS DOUBLE) AS mass, CAST(10000 AS INTEGER) AS buckets "
    f"FROM ({t.SQL_WORDS})",
)
def vec_hashing_tf(spark, sf):
    """Hashed counts: whatever the buckets, their total is the number of tokens."""
    hashed = HashingTF(inputCol="tokens", outputCol="v", numFeatures=10_000)
    vector = F.unwrap_udt("v")
    return hashed.transform(t.words(spark, sf)).select(
        "doc_id",
        F.aggregate(vector["values"], F.lit(0.0), lambda a, x: a + x).alias("mass"),
        vector["size"].alias("buckets"),
    )


@query("vec_hashing_buckets")
def vec_hashing_buckets(spark, sf):
    """Hashed counts as rows: every bucket of a document with its count."""
    hashed = HashingTF(inputCol="tokens", outputCol="v", numFeatures=10_000)
    vector = F.unwrap_udt("v")
    pairs = F.arrays_zip(vector["indices"].alias("bucket"), vector["values"].alias("tf"))
    return hashed.transform(t.words(spark, sf)).select("doc_id", F.inline(pairs)).toDF("doc_id", "bucket", "tf")


@query(
    "vec_idf_spark",
    f"WITH c AS ({_COUNTS}), d AS (SELECT term, count(*) AS df FROM c GROUP BY term), "
    "n AS (SELECT count(*) AS n FROM documents) "
    "SELECT doc_id, term, round(CASE WHEN df >= 5 THEN tf * ln((n.n + 1.0::DOUBLE) / (df + 1)) "
    "ELSE 0.0 END, 6) AS weight FROM c JOIN d USING (term), n",
)
def vec_idf_spark(spark, sf):
    counts = word_counts(spark, sf)
    total = statistics.scalar_count(t.table(spark, sf, "documents"))
    return weights.spark_idf(counts, "doc_id", total).withColumn("weight", t.rounded("weight"))


def _sql_tfidf(counts: str, keep: str, min_df: int, sublinear: bool) -> str:
    tf = "(1 + ln(tf))" if sublinear else "tf"
    return (
        f"SELECT {keep}, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM "
        f"(SELECT {keep}, term, {tf} * (ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) "
        f"/ (1 + df)) + 1) AS w FROM ({counts}) JOIN (SELECT term, count(*) AS df "
        f"FROM ({counts}) GROUP BY term HAVING count(*) >= {min_df}) USING (term))"
    )


@query(
    "vec_tfidf_l2",
    "SELECT doc_id, term, round(weight, 6) AS weight FROM "
    f"({_sql_tfidf(_COUNTS, 'doc_id', 1, False)})",
)
def vec_tfidf_l2(spark, sf):
    docs = vocabulary.document_terms(t.words(spark, sf), "tokens", "doc_id")
    total = statistics.scalar_count(t.table(spark, sf, "documents"))
    return weights.tfidf(docs, "doc_id", total).select("doc_id", F.inline("terms")).withColumn(
        "weight", t.rounded("weight")
    )


def gram_weights(spark, sf, *keep):
    """Sublinear TF-IDF over words and word pairs in at least five documents."""
    docs = vocabulary.document_terms(t.grams(spark, sf, *keep), "tokens", "doc_id", *keep)
    total = statistics.scalar_count(t.table(spark, sf, "documents"))
    rows = weights.tfidf(docs, "doc_id", total, min_df=5, sublinear=True)
    return rows.select("doc_id", *keep, F.inline("terms"))


_GRAM_COUNTS = t.sql_counts(t.SQL_GRAMS, "lang")
_GRAM_WEIGHTS = _sql_tfidf(_GRAM_COUNTS, "doc_id, lang", 5, True)


@query(
    "vec_tfidf_sublinear",
    f"SELECT doc_id, term, round(weight, 6) AS weight FROM ({_GRAM_WEIGHTS})",
)
def vec_tfidf_sublinear(spark, sf):
    return gram_weights(spark, sf).select("doc_id", "term", t.rounded("weight").alias("weight"))


def chi_scores(spark, sf):
    """Chi-square of every term against every language."""
    shares = weights.class_shares(t.table(spark, sf, "documents"), "lang")
    return weights.chi_square(gram_weights(spark, sf, "lang"), "lang", shares)


_CHI = (
    f"WITH w AS ({_GRAM_WEIGHTS}), "
    "p AS (SELECT lang, count(*)::DOUBLE / (SELECT count(*) FROM documents) AS p "
    "FROM documents GROUP BY lang), "
    "f AS (SELECT term, sum(weight) AS f FROM w GROUP BY term), "
    "o AS (SELECT term, lang, sum(weight) AS o FROM w GROUP BY term, lang), "
    "g AS (SELECT p.lang, f.term, f.f, p.p, coalesce(o.o, 0) AS o FROM p CROSS JOIN f "
    "LEFT JOIN o ON o.term = f.term AND o.lang = p.lang) "
    "SELECT lang, term, CAST(len(string_split(term, ' ')) AS INTEGER) AS ngram, "
    "(o - p * f) ** 2 / (p * f) + ((f - o) - (1 - p) * f) ** 2 / ((1 - p) * f) AS chi2 FROM g"
)


@query(
    "agg_chi2_terms",
    f"SELECT lang, term, ngram, round(chi2, 6) AS chi2 FROM ({_CHI})",
)
def agg_chi2_terms(spark, sf):
    return chi_scores(spark, sf).withColumn("chi2", t.rounded("chi2"))


@query(
    "top_chi2_per_class",
    "SELECT lang, ngram, CAST(row_number() OVER (PARTITION BY lang, ngram ORDER BY chi2 DESC, "
    "term) AS INTEGER) AS rank, term, chi2 FROM (SELECT lang, ngram, term, round(chi2, 6) AS chi2 "
    f"FROM ({_CHI})) QUALIFY rank <= 2",
)
def top_chi2_per_class(spark, sf):
    """The two words and two word pairs that go most with each language."""
    scored = chi_scores(spark, sf).withColumn("chi2", t.rounded("chi2"))
    return weights.top_per_group(scored, ["lang", "ngram"], "chi2").select(
        "lang", "ngram", "rank", "term", "chi2"
    )


_ENCODED = (
    "SELECT doc_id, list_resize(coalesce(ids, []), 160, 0) AS ids FROM documents LEFT JOIN "
    "(SELECT doc_id, list(word_id ORDER BY p) AS ids FROM (SELECT doc_id, unnest(tokens) AS word, "
    f"generate_subscripts(tokens, 1) AS p FROM ({t.SQL_REVIEW})) JOIN ({_VOCABULARY}) USING (word) "
    "WHERE p <= 160 GROUP BY doc_id) USING (doc_id)"
)


def encoded(spark, sf, words=None):
    docs = t.review_tokens(spark, sf)
    words = vocabulary.distinct_words(docs, "tokens") if words is None else words
    return vocabulary.encode_fixed(docs, "doc_id", "tokens", words, LENGTH)


@query(
    "enc_fixed_length",
    f"SELECT doc_id, array_to_string(ids, ' ') AS ids FROM ({_ENCODED})",
)
def enc_fixed_length(spark, sf):
    return encoded(spark, sf).select("doc_id", t.joined("ids").alias("ids"))


@query(
    "enc_chunk",
    "SELECT doc_id, CAST(c AS INTEGER) AS chunk, "
    "array_to_string(ids[c * 10 + 1 : c * 10 + 10], ' ') AS ids "
    f"FROM ({_ENCODED}), range(16) r(c)",
)
def enc_chunk(spark, sf):
    rows = encoded(spark, sf).select(
        "doc_id",
        F.posexplode(A.chunk(F.col("ids"), SENTENCES, WORDS_PER_SENTENCE)).alias("chunk", "ids"),
    )
    return rows.withColumn("ids", t.joined("ids"))


_SEQUENCES = (
    "SELECT doc_id, coalesce(ids, []) AS ids FROM documents LEFT JOIN "
    "(SELECT doc_id, list(word_id ORDER BY p) AS ids FROM (SELECT doc_id, unnest(tokens) AS word, "
    f"generate_subscripts(tokens, 1) AS p FROM ({t.SQL_WORDS})) JOIN ({_TOP}) USING (word) "
    "GROUP BY doc_id) USING (doc_id)"
)


def sequences(spark, sf):
    docs = t.words(spark, sf)
    return vocabulary.encode_known(
        docs, "doc_id", "tokens", vocabulary.top_words(docs, "doc_id", "tokens")
    )


@query("enc_top_n_seq", f"SELECT doc_id, array_to_string(ids, ' ') AS ids FROM ({_SEQUENCES})")
def enc_top_n_seq(spark, sf):
    return sequences(spark, sf).select("doc_id", t.joined("ids").alias("ids"))


@query(
    "enc_pad_left",
    f"WITH s AS ({_SEQUENCES}) SELECT doc_id, array_to_string(list_concat(list_resize("
    "CAST([] AS INTEGER[]), (SELECT max(len(ids)) FROM s) - len(ids), 0), ids), ' ') AS ids FROM s",
)
def enc_pad_left(spark, sf):
    return vocabulary.pad_to_longest(vocabulary.kept_sequences(sequences(spark, sf))).select(
        "doc_id", t.joined("ids").alias("ids")
    )


@query(
    "emb_vocab_vectors",
    "SELECT word, e.vec_id IS NOT NULL AS known, CAST(64 AS INTEGER) AS dims, "
    "e.vec_id IS NULL OR NULL AS bounded, "
    "round(CAST(e.embedding[1] AS DOUBLE), 6) AS first_known "
    f"FROM ({_VOCABULARY}) LEFT JOIN embeddings e ON e.vec_id = word_id",
)
def emb_vocab_vectors(spark, sf):
    """Every word gets a vector; those of unknown words stay within the bound."""
    words = vocabulary.distinct_words(t.review_tokens(spark, sf), "tokens")
    full = vectors.vocabulary_vectors(words, word_vectors(spark, sf, words), 64)
    bounded = F.forall("vector", lambda x: F.abs(x) <= vectors.UNKNOWN_BOUND)
    return full.select(
        "word", "known", F.size("vector").alias("dims"),
        F.when(~F.col("known"), bounded).alias("bounded"),
        F.when(F.col("known"), t.rounded(F.element_at("vector", 1).cast("double")))
        .alias("first_known"),
    )


def _id_vectors(spark, sf):
    return t.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("word_id"), F.col("embedding").alias("vector")
    )


def all_vectors(spark, sf, docs):
    """``(word_id, uses, vector, known)`` of every word, written."""
    words = vocabulary.distinct_words(docs, "tokens")
    full = vectors.vocabulary_vectors(words, word_vectors(spark, sf, words), 64)
    return words, written(full.select("word_id", "uses", "vector", "known"), "word-vectors")


_CHUNKS = (
    "SELECT doc_id, unnest(ids) AS word_id, generate_subscripts(ids, 1) - 1 AS pos "
    f"FROM ({_ENCODED})"
)


@query(
    "emb_lookup",
    "SELECT doc_id, CAST(pos // 10 AS INTEGER) AS chunk, "
    "count(CASE WHEN word_id > 0 THEN 1 END) AS n, count(vec_id) AS n_known, "
    "round(avg(CAST(embedding[1] AS DOUBLE)), 6) AS mean_first, "
    "round(avg(CAST(embedding[64] AS DOUBLE)), 6) AS mean_last, TRUE AS bounded "
    f"FROM ({_CHUNKS}) LEFT JOIN embeddings ON vec_id = word_id AND word_id > 0 GROUP BY 1, 2",
)
def emb_lookup(spark, sf):
    """Vectors of all encoded words, summarised per chunk; padding has none.

    Words without a given vector have one within the bound; the means are over given ones.
    """
    # Cut into words once: the vocabulary and the encoding both read them.
    docs = written(t.review_tokens(spark, sf), "tokens")
    words, full = all_vectors(spark, sf, docs)
    ids = vocabulary.encode_fixed(docs, "doc_id", "tokens", words, LENGTH)
    looked = vectors.token_vectors(ids, "doc_id", full, "uses")
    given = lambda i: F.when(F.col("known"), F.element_at("vector", i).cast("double"))
    inside = F.forall("vector", lambda x: F.abs(x) <= vectors.UNKNOWN_BOUND)
    return looked.groupBy("doc_id", F.floor(F.col("pos") / WORDS_PER_SENTENCE).cast("int").alias("chunk")).agg(
        F.count("vector").alias("n"),
        F.count_if("known").alias("n_known"),
        t.rounded(F.avg(given(1))).alias("mean_first"),
        t.rounded(F.avg(given(64))).alias("mean_last"),
        F.coalesce(F.every(F.when(~F.col("known"), inside)), F.lit(True)).alias("bounded"),
    )


def pooled_documents(spark, sf):
    """``(doc_id, n, n_known, sums, known_sums)``: per dimension the sum over all words, and over known ones."""
    docs = t.review_tokens(spark, sf)
    words, full = all_vectors(spark, sf, docs)
    ids = vocabulary.kept_sequences(vocabulary.encode_known(docs, "doc_id", "tokens", words))
    return vectors.pooled_sums(ids, "doc_id", full, "uses")


@query(
    "emb_doc_mean",
    f"WITH w AS (SELECT doc_id, unnest(tokens) AS word FROM ({t.SQL_REVIEW})), "
    f"k AS (SELECT doc_id, vec_id, embedding FROM w JOIN ({_VOCABULARY}) USING (word) "
    "LEFT JOIN embeddings ON vec_id = word_id), "
    "n AS (SELECT doc_id, count(*) AS n, count(vec_id) AS n_known FROM k GROUP BY doc_id), "
    "m AS (SELECT doc_id, CAST(d - 1 AS INTEGER) AS dim, round(avg(value), 6) AS value FROM "
    "(SELECT doc_id, CAST(unnest(embedding) AS DOUBLE) AS value, generate_subscripts(embedding, 1) "
    "AS d FROM k WHERE vec_id IS NOT NULL) GROUP BY ALL) "
    "SELECT doc_id, coalesce(n, 0) AS n, coalesce(n_known, 0) AS n_known, CAST(r.d AS INTEGER) AS dim, "
    "value, TRUE AS bounded FROM documents CROSS JOIN range(64) r(d) LEFT JOIN n USING (doc_id) "
    "LEFT JOIN m ON m.doc_id = documents.doc_id AND m.dim = r.d",
)
def emb_doc_mean(spark, sf):
    """Mean vector of each document's given words, and the bound of the mean over all words."""
    n, known = F.col("n"), F.col("n_known")
    return (
        pooled_documents(spark, sf)
        .select("doc_id", n, known, "sums", "known_sums", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("dim"))
        .select(
            "doc_id", "n", "n_known", "dim",
            t.rounded(F.when(known > 0, F.get("known_sums", F.col("dim")) / known)).alias("value"),
            F.coalesce(
                F.abs(F.get("sums", "dim") - F.get("known_sums", "dim"))
                <= (n - known) * vectors.UNKNOWN_BOUND + 1e-6,
                F.lit(True),
            ).alias("bounded"),
        )
    )


@query(
    "num_min_max",
    "WITH e AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, "
    "generate_subscripts(embedding, 1) AS d FROM embeddings), "
    "m AS (SELECT min(x) AS lo, max(x) AS hi FROM e) "
    "SELECT vec_id, CAST(d - 1 AS INTEGER) AS dim, round((x - lo) / (hi - lo), 6) AS value "
    "FROM e, m",
)
def num_min_max(spark, sf):
    rows = t.table(spark, sf, "embeddings").select("vec_id", "embedding")
    return weights.min_max(rows, "embedding", "scaled").select(
        "vec_id", F.posexplode("scaled").alias("dim", "value")
    ).withColumn("value", t.rounded("value"))

"""Training, tuning, scoring and model-comparison queries."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelloom.operators import (
    bayes, evaluation, shards, splits, statistics, training, vectors, vocabulary, weights,
)
from labelloom.operators.keyed import hash_threshold
from labelloom.functions import text as T
from labelloom.functions.arrays import argmax
from labelloom.functions.text import TOKENIZER_STOP_WORDS
from labelloom.plans import tables as t
from labelloom.plans.registry import query
from labelloom.plans.tables_io import SENTENCES, SQL_SENTENCES, word_vectors
from labelloom.sources import readers, writers
from labelloom.storage import new_path, written

# Fixed value: shards of the sharded training.
SHARDS = 4


def split_tweets(spark, sf):
    """Tweets with text, 70 % of them for training."""
    rows = t.tweets(spark, sf).filter(F.col("content").isNotNull())
    return splits.split_random(rows, "tweet_id", {"train": 0.7, "test": 0.3}, seed=100)


def count_features(spark, sf):
    rows = split_tweets(spark, sf)
    fitted = training.fit_features(training.count_stages(), rows)
    return fitted, fitted.transform(rows)


def _parts(rows):
    return rows.filter("split = 'train'"), rows.filter("split = 'test'")


def _fit_and_score(spark, sf, estimator, features=count_features):
    fitted, rows = features(spark, sf)
    train, test = _parts(rows)
    model = training.fit_kept(estimator, train.select("features", "label"))
    return training.label_names(model.transform(test), training.label_order(fitted))


def _report(scored):
    return scored.select("tweet_id", "sentiment", "label", "prediction", "predicted")


# The count features in SQL: words of the lower-cased text without the listed stop words;
# terms of at least five training documents; labels by training frequency.
_STOPS = "[" + ", ".join(t.quoted(w) for w in dict.fromkeys(TOKENIZER_STOP_WORDS)) + "]"
_TRAIN = f"{t.sql_hash('doc_id', 100)} < '{hash_threshold(0.7)}'"
_ML_DOCS = (
    f"SELECT doc_id, lang, {_TRAIN} AS train, "
    "list_filter(regexp_extract_all(lower(text), '[0-9a-z]+'), "
    f"lambda w: NOT list_contains({_STOPS}, w)) AS tokens FROM documents"
)
_ML = (
    f"WITH d AS MATERIALIZED ({_ML_DOCS}), "
    "a AS (SELECT doc_id, lang, train, term, count(*) AS tf FROM "
    "(SELECT doc_id, lang, train, unnest(tokens) AS term FROM d) GROUP BY ALL), "
    "w AS (SELECT term FROM a WHERE train GROUP BY term HAVING count(*) >= 5 "
    "ORDER BY sum(tf) DESC, term LIMIT 10000), "
    "c AS (SELECT * FROM a SEMI JOIN w USING (term)), "
    "k AS (SELECT lang, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, lang) - 1 "
    "AS DOUBLE) AS label FROM d WHERE train GROUP BY lang) "
)


@query(
    "ml_features_count",
    _ML + "SELECT d.doc_id AS tweet_id, CASE WHEN d.train THEN 'train' ELSE 'test' END AS split, "
    "lang AS sentiment, label, CAST(len(tokens) AS INTEGER) AS tokens, "
    "CAST(coalesce((SELECT sum(tf) FROM c WHERE c.doc_id = d.doc_id), 0) AS DOUBLE) AS counted "
    "FROM d JOIN k USING (lang)",
)
def ml_features_count(spark, sf):
    """Tokenise, drop stop words, count terms, index the label."""
    _, rows = count_features(spark, sf)
    values = F.unwrap_udt("features")["values"]
    return rows.select(
        "tweet_id", "split", "sentiment", "label", F.size("filtered").alias("tokens"),
        F.aggregate(values, F.lit(0.0), lambda a, x: a + x).alias("counted"),
    )


@query("ml_features_hash_idf")
def ml_features_hash_idf(spark, sf):
    """Tokenise, drop stop words, hash terms, weigh by IDF, index the label."""
    rows = split_tweets(spark, sf)
    out = training.fit_features(training.hash_idf_stages(), rows).transform(rows)
    norm = F.sqrt(
        F.aggregate(F.unwrap_udt("features")["values"], F.lit(0.0), lambda a, x: a + x * x)
    )
    return out.select("tweet_id", "split", "sentiment", "label", t.rounded(norm).alias("norm"))


def _verdict(scored, actual="sentiment"):
    """Rows of each class, the share of the largest, and whether the model does better."""
    counts = scored.groupBy(actual).agg(
        F.count("*").alias("support"),
        F.sum((F.col("prediction") == F.col("label")).cast("int")).alias("_hits"),
    )
    # One row per class.
    whole = W.partitionBy(F.lit(1))
    total, largest = F.sum("support").over(whole), F.max("support").over(whole)
    return counts.select(
        actual, "support", t.rounded(largest / total).alias("majority"),
        (F.sum("_hits").over(whole) > largest).alias("beats_majority"),
    )


def _sql_verdict(test: str) -> str:
    return (
        "SELECT sentiment, count(*) AS support, round(max(count(*)) OVER () / "
        f"CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS majority, TRUE AS beats_majority "
        f"FROM ({test}) GROUP BY sentiment"
    )


_TEST = f"SELECT lang AS sentiment FROM documents WHERE NOT {_TRAIN}"


def hash_idf_features(spark, sf):
    rows = split_tweets(spark, sf)
    fitted = training.fit_features(training.hash_idf_stages(), rows)
    return fitted, fitted.transform(rows)


@query(
    "ml_logreg",
    f"SELECT f AS features, v.* FROM (VALUES ('count'), ('hash_idf')) k(f), ({_sql_verdict(_TEST)}) v",
)
def ml_logreg(spark, sf):
    """Logistic regression on counts and on hashed, IDF-weighted counts."""
    reports = [
        _verdict(_fit_and_score(spark, sf, training.logistic_regression(), make)).select(
            F.lit(name).alias("features"), "*"
        )
        for name, make in (("count", count_features), ("hash_idf", hash_idf_features))
    ]
    return reports[0].union(reports[1])


_ML_NB = (
    _ML + ", m AS (SELECT lang, sum(tf) AS mass FROM c WHERE train GROUP BY lang), "
    "pi AS (SELECT lang, label, ln(n + 1.0::DOUBLE) - ln((SELECT sum(n) + count(*) FROM k)::DOUBLE) "
    "AS pi, ln((mass + (SELECT count(*) FROM w))::DOUBLE) AS bottom FROM k JOIN m USING (lang)), "
    "tc AS (SELECT term, lang, sum(tf) AS tf FROM c WHERE train GROUP BY term, lang), "
    "th AS (SELECT w.term, pi.lang, ln(coalesce(tc.tf, 0) + 1.0::DOUBLE) - bottom AS theta "
    "FROM w CROSS JOIN pi LEFT JOIN tc ON tc.term = w.term AND tc.lang = pi.lang) "
)


@query(
    "ml_naive_bayes",
    _ML_NB + ", s AS (SELECT doc_id, th.lang, sum(tf * theta) AS s FROM c JOIN th USING (term) "
    "WHERE NOT train GROUP BY ALL), "
    "b AS (SELECT d.doc_id, arg_max(pi.label, coalesce(s.s, 0) + pi.pi) AS prediction FROM d "
    "CROSS JOIN pi LEFT JOIN s ON s.doc_id = d.doc_id AND s.lang = pi.lang "
    "WHERE NOT d.train GROUP BY d.doc_id) "
    "SELECT d.doc_id AS tweet_id, d.lang AS sentiment, k.label, b.prediction, p.lang AS predicted "
    "FROM b JOIN d USING (doc_id) JOIN k ON k.lang = d.lang JOIN k p ON p.label = b.prediction",
)
def ml_naive_bayes(spark, sf):
    return _report(_fit_and_score(spark, sf, training.naive_bayes()))


@query("ml_random_forest", _sql_verdict(_TEST))
def ml_random_forest(spark, sf):
    return _verdict(_fit_and_score(spark, sf, training.random_forest()))


def tfidf_features(spark, sf):
    """``(labels, terms, rows)``: numbered terms, and documents with unit-length TF-IDF vectors.

    Sublinear weights of words and word pairs that stand in five documents or more.
    """
    docs = written(vocabulary.document_terms(t.grams(spark, sf, "lang"), "tokens", "doc_id", "lang"), "document-terms")
    total = statistics.scalar_count(t.table(spark, sf, "documents"))
    terms = vocabulary.numbered_terms(weights.idf_table(docs.select(F.inline("terms")), total, 5))
    scored = weights.tfidf(docs, "doc_id", total, sublinear=True, fitted=terms, carry=["term_id"])
    rows = scored.select("doc_id", "lang", vectors.sparse_vectors("terms", terms.count()).alias("features"))
    placed = vectors.written_vectors(rows, "features", "tfidf-vectors")
    index = StringIndexer(inputCol="lang", outputCol="label").fit(placed)
    return list(index.labels), terms, index.transform(placed).withColumnRenamed("lang", "sentiment")


_HOLDOUT = (
    "SELECT doc_id, lang AS sentiment, row_number() OVER "
    f"(ORDER BY {t.sql_hash('doc_id', 0)}, doc_id) <= ceil(count(*) OVER () * 0.33::DOUBLE) AS test "
    "FROM documents"
)


class SvcRun:
    """A linear SVM fitted on two thirds of the rows, and all that is reported of it.

    Every report reads the one written table of predictions.
    """

    def __init__(self, spark, sf):
        self.labels, self.terms, self.rows = tfidf_features(spark, sf)
        train, test = _parts(splits.split_exact_two(self.rows, "doc_id", 0.33))
        self.partitions = training.wide_partitions(self.rows)
        self.width = self.terms.count()
        self.svc = training.linear_svc(training.fits_at_once(spark, self.width))
        model = training.fit_kept(self.svc, train.select("features", "label"), self.partitions)
        self.predictions = written(
            training.label_names(model.transform(test), self.labels)
            .select("doc_id", "sentiment", "label", "prediction", "predicted"),
            "svc-predictions",
        )
        self.cells = evaluation.confusion(self.predictions, "sentiment", "predicted")
        self.texts = t.table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"))

    def pairs(self, minimum=6):
        """Pairs of classes that are taken for one another at least so often."""
        return evaluation.confused_pairs(self.cells, minimum)

    def errors(self, minimum=6):
        """Wrongly predicted texts of such pairs."""
        wrong = evaluation.misclassified(self.predictions, self.texts, "doc_id", "sentiment", "predicted")
        pairs = self.pairs(minimum).select(F.col("actual").alias("sentiment"), "predicted", "n")
        return wrong.join(F.broadcast(pairs), ["sentiment", "predicted"])  # classes x classes at most

    def report(self):
        return evaluation.class_report(self.cells)

    def refitted(self):
        """The model fitted again, on all rows."""
        return training.fit_kept(self.svc, self.rows.select("features", "label"), self.partitions)

    def score_texts(self, model, texts, key="doc_id", content="content"):
        """Texts with the label name that a model gives them, through the fitted terms."""
        spark = texts.sparkSession
        kept = T.unigrams_bigrams(F.col("_t"))
        tokens = texts.select(key, T.long_words(T.word_tokens(F.col(content))).alias("_t")).select(key, kept.alias("tokens"))
        docs = written(vocabulary.document_terms(tokens, "tokens", key), "document-terms")
        # The fitted table has the weights; the number of rows is not asked for.
        scored = weights.tfidf(docs, key, F.lit(0), sublinear=True, fitted=self.terms, carry=["term_id"])
        rows = scored.select(key, vectors.sparse_vectors("terms", self.width).alias("features"))
        named = training.label_names(model.transform(vectors.written_vectors(rows, "features", "text-vectors")), self.labels)
        return texts.join(named.select(key, F.col("predicted").alias("predicted_sentiment")), key)


@query(
    "ml_linear_svc",
    "SELECT actual, n, n AS reported, n AS shown, majority, beats_majority, "
    "(SELECT count(*) FROM documents) AS refitted_on FROM (SELECT sentiment AS actual, "
    "support AS n, majority, beats_majority FROM "
    f"({_sql_verdict(f'SELECT * FROM ({_HOLDOUT}) WHERE test')}))",
)
def ml_linear_svc(spark, sf):
    """A third held out, fitted on the rest: rows of each class in the confusion cells, in the
    report, and among right predictions and listed errors; rows of the refit."""
    run = SvcRun(spark, sf)
    supports = run.cells.groupBy("actual").agg(F.sum("n").alias("n"))
    reported = run.report().select(F.col("class").alias("actual"), F.col("support").alias("reported"))
    right = run.cells.filter("actual = predicted").select("actual", F.col("n").alias("right"))
    wrong = run.errors(1).groupBy(F.col("sentiment").alias("actual")).agg(F.count("content").alias("wrong"))
    verdict = _verdict(run.predictions).select(F.col("sentiment").alias("actual"), "majority", "beats_majority")
    model = run.refitted()
    known = model.transform(run.rows).filter("prediction is not null").count()
    return (
        supports.join(reported, "actual").join(right, "actual").join(wrong, "actual", "left").join(verdict, "actual")
        .select(
            "actual", "n", "reported", (F.col("right") + F.coalesce("wrong", F.lit(0))).alias("shown"),
            "majority", "beats_majority", F.lit(known).cast("long").alias("refitted_on"),
        )
    )


@query("ml_svc_report")
def ml_svc_report(spark, sf):
    """Precision, recall and F1 of every class, and their averages."""
    report = SvcRun(spark, sf).report()
    return report.select("class", *[t.rounded(c).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("ml_svc_sentences")
def ml_svc_sentences(spark, sf):
    """Label names for literal sentences, by the model fitted again on all documents."""
    run = SvcRun(spark, sf)
    return run.score_texts(run.refitted(), readers.inline_rows(spark, SENTENCES))


_NB_COUNTS = t.sql_counts(t.SQL_WORDS, "lang")
_NB = (
    f"WITH c AS ({_NB_COUNTS}), tr AS (SELECT * FROM c WHERE {_TRAIN}), "
    f"k AS (SELECT lang, count(*) AS n FROM documents WHERE {_TRAIN} GROUP BY lang), "
    "m AS (SELECT lang, sum(tf) AS mass FROM tr GROUP BY lang), "
    "v AS (SELECT count(DISTINCT term) AS v FROM tr), "
    "pi AS (SELECT lang, ln(n + 1.0::DOUBLE) - ln((SELECT sum(n) + count(*) FROM k)::DOUBLE) AS pi, "
    "ln((mass + v.v)::DOUBLE) AS bottom FROM k JOIN m USING (lang), v), "
    "tc AS (SELECT term, lang, sum(tf) AS tf FROM tr GROUP BY term, lang), "
    "th AS (SELECT w.term, pi.lang, ln(coalesce(tc.tf, 0) + 1.0::DOUBLE) - bottom AS theta "
    "FROM (SELECT DISTINCT term FROM tr) w CROSS JOIN pi "
    "LEFT JOIN tc ON tc.term = w.term AND tc.lang = pi.lang), "
    f"te AS (SELECT doc_id, term, tf FROM c WHERE NOT {_TRAIN}), "
    "s AS (SELECT doc_id, th.lang, sum(tf * theta) AS s FROM te JOIN th USING (term) GROUP BY ALL), "
    f"d AS (SELECT doc_id FROM documents WHERE NOT {_TRAIN}) "
)


def _nb_parts(spark, sf):
    docs = splits.split_random(
        t.words(spark, sf, "lang"), "doc_id", {"train": 0.7, "test": 0.3}, seed=100
    )
    train, test = _parts(docs)
    classes, terms = bayes.fit(
        train, vocabulary.term_counts(train, "tokens", "lang"), "lang"
    )
    return test, classes, terms


@query(
    "ml_naive_bayes_sql",
    _NB + "SELECT doc_id, arg_max(pi.lang, coalesce(s.s, 0) + pi.pi) AS prediction, "
    "round(max(coalesce(s.s, 0) + pi.pi), 3) AS score FROM d CROSS JOIN pi "
    "LEFT JOIN s USING (doc_id, lang) GROUP BY doc_id",
)
def ml_naive_bayes_sql(spark, sf):
    """Naive Bayes from group-bys: fitted on one part, scored on the other."""
    test, classes, terms = _nb_parts(spark, sf)
    counts = vocabulary.document_terms(test, "tokens", "doc_id")
    scores = bayes.score(test, counts, "doc_id", classes, terms, "lang")
    return bayes.predict(scores, "doc_id").withColumn("score", t.rounded("score", 3))


@query(
    "top_weight_per_class",
    _NB + "SELECT lang, rank, term, theta FROM (SELECT lang, term, round(theta, 6) AS theta, "
    "CAST(row_number() OVER (PARTITION BY lang ORDER BY round(theta, 6) DESC, term) AS INTEGER) "
    "AS rank FROM th) WHERE rank <= 2",
)
def top_weight_per_class(spark, sf):
    """The two terms with the highest naive-Bayes weight in each class."""
    _, classes, terms = _nb_parts(spark, sf)
    table = bayes.theta(classes, terms, "lang").withColumn("theta", t.rounded("theta"))
    return weights.top_per_group(table, ["lang"], "theta").select("lang", "rank", "term", "theta")


@query("top_coef_per_class")
def top_coef_per_class(spark, sf):
    """Two words and two word pairs with the highest weight in a linear model per class."""
    labels, terms, rows = tfidf_features(spark, sf)
    svc = training.linear_svc(training.fits_at_once(spark, terms.count()))
    model = training.fit_kept(svc, rows.select("features", "label"), training.wide_partitions(rows))
    table = training.coefficients(model, terms, labels).withColumn(
        "ngram", F.size(F.split("term", " "))
    )
    return weights.top_per_group(
        table.withColumn("weight", t.rounded("weight")), ["label", "ngram"], "weight"
    ).select("label", "ngram", "rank", "term", "weight")


@query("ml_grid_cv")
def ml_grid_cv(spark, sf):
    """F1 of each grid point over five folds, and of the best model on the test part."""
    rows = splits.fold_random(count_features(spark, sf)[1], "tweet_id", 5)
    train, test = _parts(rows.select("split", "fold", "features", "label"))
    model = training.tune(train, "fold")
    held_out = training.evaluator().evaluate(model.transform(test))
    return training.grid_results(model, spark).withColumn("test_f1", F.lit(float(held_out)))


_FOLDS = (
    "SELECT lang, CAST((row_number() OVER (PARTITION BY lang ORDER BY "
    f"{t.sql_hash('doc_id', 0)}, doc_id) - 1) % 5 AS INTEGER) AS fold FROM documents"
)


@query(
    "ml_compare_models",
    "SELECT m AS model_name, fold AS fold_idx, CAST(total AS BIGINT) AS rows, majority, TRUE AS beats_majority "
    "FROM (VALUES ('random_forest'), ('linear_svc'), ('naive_bayes'), ('logistic_regression')) k(m), "
    "(SELECT fold, sum(n) AS total, round(CAST(max(n) AS DOUBLE) / sum(n), 6) AS majority FROM "
    f"(SELECT fold, lang, count(*) AS n FROM ({_FOLDS}) GROUP BY ALL) GROUP BY fold) f",
)
def ml_compare_models(spark, sf):
    """Four models on five stratified folds of the TF-IDF vectors."""
    _, _, rows = tfidf_features(spark, sf)
    folded = splits.fold_stratified(rows, "doc_id", "sentiment", 5)
    size = rows.count()
    scores = training.compare_models(
        folded.select("features", "label", "fold"),
        {
            "random_forest": training.random_forest(**training.FOREST_WIDE),
            "linear_svc": training.linear_svc(),
            "naive_bayes": training.naive_bayes(),
            # Unit strength against the sum of losses is 1 / rows against their mean.
            "logistic_regression": training.logistic_regression(regParam=1 / max(1, size), maxIter=100),
        },
        "fold",
    )
    per_class = folded.groupBy("fold", "sentiment").agg(F.count("*").alias("n"))
    sizes = per_class.groupBy("fold").agg(F.sum("n").alias("rows"), F.max("n").alias("most"))
    return scores.join(sizes, scores["fold_idx"] == sizes["fold"]).select(
        "model_name", "fold_idx", "rows", t.rounded(F.col("most") / F.col("rows")).alias("majority"),
        (F.col("accuracy") >= F.col("most") / F.col("rows")).alias("beats_majority"),
    )


@query(
    "ml_score_adhoc",
    _ML_NB + f", q AS (SELECT * FROM ({SQL_SENTENCES})), "
    "u AS (SELECT id, unnest(regexp_extract_all(lower(content), '[0-9a-z]+')) AS term FROM q), "
    "s AS (SELECT id, lang, sum(theta) AS s FROM u JOIN th USING (term) "
    f"WHERE NOT list_contains({_STOPS}, term) GROUP BY ALL) "
    "SELECT q.id AS doc_id, q.content, arg_max(pi.lang, coalesce(s.s, 0) + pi.pi) "
    "AS predicted_sentiment FROM q CROSS JOIN pi LEFT JOIN s ON s.id = q.id AND s.lang = pi.lang "
    "GROUP BY ALL",
)
def ml_score_adhoc(spark, sf):
    """Label names for literal sentences, through the stages fitted on the documents."""
    fitted, rows = count_features(spark, sf)
    model = training.fit_kept(training.naive_bayes(), _parts(rows)[0].select("features", "label"))
    texts = readers.inline_rows(spark, SENTENCES)
    return training.score_texts(fitted, model, texts).select(
        "doc_id", "content", "predicted_sentiment"
    )


def _sql_nb(smoothing: int) -> str:
    """Accuracy of naive Bayes on the count features of the test part."""
    k = f"{smoothing}.0::DOUBLE"
    return (
        _ML + ", m AS (SELECT lang, sum(tf) AS mass FROM c WHERE train GROUP BY lang), "
        f"pi AS (SELECT lang, label, ln(n + {k}) - ln((SELECT sum(n) + {k} * count(*) FROM k)::DOUBLE) AS pi, "
        f"ln((mass + {k} * (SELECT count(*) FROM w))::DOUBLE) AS bottom FROM k JOIN m USING (lang)), "
        "tc AS (SELECT term, lang, sum(tf) AS tf FROM c WHERE train GROUP BY term, lang), "
        f"th AS (SELECT w.term, pi.lang, ln(coalesce(tc.tf, 0) + {k}) - bottom AS theta "
        "FROM w CROSS JOIN pi LEFT JOIN tc ON tc.term = w.term AND tc.lang = pi.lang), "
        "s AS (SELECT doc_id, th.lang, sum(tf * theta) AS s FROM c JOIN th USING (term) "
        "WHERE NOT train GROUP BY ALL), "
        "b AS (SELECT d.doc_id, any_value(d.lang) AS lang, arg_max(pi.lang, coalesce(s.s, 0) + pi.pi) AS predicted "
        "FROM d CROSS JOIN pi LEFT JOIN s ON s.doc_id = d.doc_id AND s.lang = pi.lang "
        "WHERE NOT d.train GROUP BY d.doc_id) "
        "SELECT avg(CASE WHEN lang = predicted THEN 1.0::DOUBLE ELSE 0.0 END) AS accuracy FROM b"
    )


def _saved_models(spark, sf, steps):
    """A run of saves: the model of each step smooths a little more."""
    fitted, rows = count_features(spark, sf)
    train, _ = _parts(rows)
    run = new_path(spark, "model")
    with training.kept(train.select("features", "label")) as cached:
        for i, step in enumerate(steps, start=1):
            model = training.naive_bayes(smoothing=float(i)).fit(cached)
            writers.save_model(spark, PipelineModel([*fitted.stages, model]), run, step)
    return run


@query(
    "sink_model",
    "SELECT CAST(step AS BIGINT) AS step, CAST(step // 100 % 5 AS INTEGER) AS slot, "
    f"CASE WHEN step = 700 THEN round((SELECT accuracy FROM ({_sql_nb(7)})), 6) END AS accuracy "
    "FROM range(300, 800, 100) r(step)",
)
def sink_model(spark, sf):
    """Seven saves, of which the newest five can be restored; scored with the newest."""
    run = _saved_models(spark, sf, range(100, 800, 100))
    step, model = writers.load_latest(spark, run)
    test = _parts(split_tweets(spark, sf))[1]
    hits = evaluation.accuracy(model.transform(test), "label", "prediction").first()[0]
    return writers.saved_steps(spark, run).withColumn(
        "accuracy", F.when(F.col("step") == step, t.rounded(F.lit(float(hits))))
    )


@query("ml_score_batch", f"SELECT round(accuracy, 6) AS accuracy FROM ({_sql_nb(1)})")
def ml_score_batch(spark, sf):
    """Restore a saved model, score the test part once, report accuracy."""
    run = _saved_models(spark, sf, [100])
    _, model = writers.load_latest(spark, run)
    test = _parts(split_tweets(spark, sf))[1]
    return evaluation.accuracy(model.transform(test), "label", "prediction").select(
        t.rounded("accuracy").alias("accuracy")
    )


@query("ml_doc_network")
def ml_doc_network(spark, sf):
    """A neural classifier over pooled word vectors; every word of the corpus has one."""
    marks = t.table(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("label"))
    docs = t.review_tokens(spark, sf)
    words = vocabulary.distinct_words(docs, "tokens")
    full = written(
        vectors.vocabulary_vectors(words, word_vectors(spark, sf, words), 64), "word-vectors"
    )
    ids = vocabulary.kept_sequences(vocabulary.encode_known(docs, "doc_id", "tokens", words))
    means = vectors.pooled(ids, "doc_id", full.select("word_id", "uses", "vector"), "uses")
    # A document without words has no vector; it counts as the zero vector.
    vector = F.coalesce("vector", F.array_repeat(F.lit(0.0), 64))
    rows = means.join(marks, "doc_id").select(
        "doc_id", "label", array_to_vector(vector).alias("features")
    )
    parts = splits.split_random(rows, "doc_id", {"train": 0.7, "test": 0.3}, seed=100)
    train, test = _parts(parts)
    model = training.fit_kept(training.perceptron(64, 16, 2), train.select("features", "label"))
    return model.transform(test).select("doc_id", "label", "prediction")


@query("ml_shard_average")
def ml_shard_average(spark, sf):
    """Weights trained shard by shard on numeric rows and averaged by position."""
    ordered = t.table(spark, sf, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("x"), "label"
    )
    trained = shards.train_shards(
        ordered, "vec_id", "x", "label", dims=64, classes=10, shards=SHARDS
    )
    averaged = written(shards.mean_weights(trained), "mean-weights")
    scored = shards.score_linear(ordered, "x", averaged, 64, 10)
    return scored.select("vec_id", "label", argmax(F.col("scores")).alias("prediction"))


@query("ml_monitor")
def ml_monitor(spark, sf):
    """Loss and accuracy of both parts after each step, appended and read back.

    A fit of k iterations is the model after k steps, so each step of the whole fit has a
    model of its own; all of them score the rows in one scan.
    """
    _, rows = count_features(spark, sf)
    path = new_path(spark, "metrics")
    with training.kept(rows.select("split", "features", "label")) as cached:
        train = cached.filter("split = 'train'")
        models = [
            training.logistic_regression(maxIter=step).fit(train) for step in range(1, training.LR_ITERATIONS + 1)
        ]
        writers.append_metrics(training.steps_metrics(models, cached), path, "run-1")
    return writers.read_metrics(spark, path)

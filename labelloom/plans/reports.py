"""Confusion, report, loss and ranking queries over given labels and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloom.operators import evaluation
from labelloom.plans import tables as t
from labelloom.plans.registry import query

_CELLS = (
    f"SELECT a.k AS actual, p.k AS predicted, count(m.doc_id) AS n FROM (VALUES (0), (1)) a(k) "
    f"CROSS JOIN (VALUES (0), (1)) p(k) LEFT JOIN ({t.SQL_MARKED}) m "
    "ON m.actual = a.k AND m.predicted = p.k GROUP BY ALL"
)


def _cells(spark, sf):
    return evaluation.confusion(t.marked(spark, sf), "actual", "predicted")


@query("agg_confusion", _CELLS)
def agg_confusion(spark, sf):
    return _cells(spark, sf)


@query("agg_confused_pairs", f"SELECT * FROM ({_CELLS}) WHERE actual <> predicted AND n >= 6")
def agg_confused_pairs(spark, sf):
    return evaluation.confused_pairs(_cells(spark, sf), 6)


_SCORES = (
    f"SELECT k.k, sum(CASE WHEN actual = k.k AND predicted = k.k THEN 1 ELSE 0 END)::DOUBLE AS tp, "
    "sum(CASE WHEN predicted = k.k THEN 1 ELSE 0 END) AS claimed, "
    "sum(CASE WHEN actual = k.k THEN 1 ELSE 0 END) AS support "
    f"FROM ({t.SQL_MARKED}), (VALUES (0), (1)) k(k) GROUP BY k.k"
)
_RATED = (
    "SELECT k, tp, support, precision, recall, CASE WHEN precision + recall = 0 THEN 0 ELSE "
    "2 * precision * recall / (precision + recall) END AS f1 FROM (SELECT k, tp, support, "
    "CASE WHEN claimed = 0 THEN 0 ELSE tp / claimed END AS precision, "
    f"CASE WHEN support = 0 THEN 0 ELSE tp / support END AS recall FROM ({_SCORES}))"
)


@query(
    "agg_class_report",
    f"WITH r AS ({_RATED}), a AS ("
    "SELECT CAST(k AS VARCHAR) AS class, precision, recall, f1, support FROM r UNION ALL "
    "SELECT 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support), "
    "sum(support) FROM r UNION ALL "
    "SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM r UNION ALL "
    "SELECT 'weighted avg', sum(precision * support) / sum(support), "
    "sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM r) "
    "SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, "
    "round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM a",
)
def agg_class_report(spark, sf):
    report = evaluation.class_report(_cells(spark, sf))
    return report.select(
        "class", *[t.rounded(c).alias(c) for c in ("precision", "recall", "f1")], "support"
    )


@query(
    "agg_accuracy",
    "SELECT round(avg(CASE WHEN actual = predicted THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy "
    f"FROM ({t.SQL_MARKED})",
)
def agg_accuracy(spark, sf):
    return evaluation.accuracy(t.marked(spark, sf), "actual", "predicted").select(
        t.rounded("accuracy").alias("accuracy")
    )


@query(
    "agg_weighted_f1",
    f"SELECT round(sum(f1 * support) / sum(support), 6) AS f1 FROM ({_RATED})",
)
def agg_weighted_f1(spark, sf):
    return evaluation.weighted_f1(_cells(spark, sf)).select(t.rounded("f1").alias("f1"))


# Ten raw scores per row: the first ten entries of each embedding, for its ten labels.
_SCORE_ROWS = (
    "SELECT vec_id, label, list_transform(embedding[1:10], lambda x: CAST(x AS DOUBLE)) AS scores "
    "FROM embeddings"
)


def _scores(spark, sf):
    return t.table(spark, sf, "embeddings").select(
        "vec_id", "label", F.slice("embedding", 1, 10).cast("array<double>").alias("scores")
    )


@query(
    "agg_log_loss",
    "SELECT round(avg(ln(list_sum(list_transform(scores, lambda s: exp(s - list_max(scores))))) "
    f"+ list_max(scores) - scores[label + 1]), 6) AS log_loss FROM ({_SCORE_ROWS})",
)
def agg_log_loss(spark, sf):
    return evaluation.log_loss(_scores(spark, sf), "scores", "label").select(
        t.rounded("log_loss").alias("log_loss")
    )


@query(
    "agg_l2_penalty",
    "SELECT round(0.01::DOUBLE * sum(w * w) / 2, 6) AS penalty FROM "
    "(SELECT CAST(unnest(embedding) AS DOUBLE) AS w FROM embeddings)",
)
def agg_l2_penalty(spark, sf):
    weights = t.table(spark, sf, "embeddings").select(
        F.explode(F.col("embedding").cast("array<double>")).alias("w")
    )
    return evaluation.l2_penalty(weights, "w", 0.01).select(t.rounded("penalty").alias("penalty"))

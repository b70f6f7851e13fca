"""Spark ML pipelines, model comparison and scoring."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import (
    LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes, OneVsRest,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import (
    IDF, CountVectorizer, HashingTF, IndexToString, RegexTokenizer, StopWordsRemover,
    StringIndexer, StringIndexerModel,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from labelloom.functions.text import TOKENIZER_STOP_WORDS, TWEET_NOISE
from labelloom.operators.forest import SparseForest
from labelloom.storage import new_path

# Sizes and hyper-parameters of the text models.
VOCABULARY = 10_000
MIN_DF = 5
LR_ITERATIONS = 20
LR_REG = 0.3
GRID_REG = [0.1, 0.3, 0.5]
GRID_ELASTIC = [0.0, 0.1, 0.2]
CV_FOLDS = 5
FOREST_SPARK = {"numTrees": 100, "maxDepth": 4, "maxBins": 32}
# Entries of sparse rows that one partition of an iterative fit may hold.
PARTITION_ENTRIES = 20_000_000
# Vectors of one number per feature that a linear fit has on the driver at a time: ten steps and
# ten differences of gradients, the points between them, what is broadcast, and the sums of the
# tasks, as they arrive and as they are read. Two fits took more than twice 28 together.
FIT_VECTORS = 64
FOREST_WIDE = {"numTrees": 200, "maxDepth": 3}


def _tokens(text: str, as_gaps: bool) -> list:
    if as_gaps:
        tokenizer = RegexTokenizer(inputCol=text, outputCol="words", pattern=TWEET_NOISE)
    else:
        tokenizer = RegexTokenizer(
            inputCol=text, outputCol="words", gaps=False, pattern="[0-9A-Za-z]+"
        )
    remover = StopWordsRemover(inputCol="words", outputCol="filtered").setStopWords(
        TOKENIZER_STOP_WORDS
    )
    return [tokenizer, remover]


def count_stages(
    text: str = "content", label: str = "sentiment", as_gaps: bool = False,
    vocabulary: int = VOCABULARY, min_df: float = MIN_DF,
) -> list:
    """Tokenise, drop stop words, count the most frequent terms, index the label.

    ``as_gaps`` uses the cleaning pattern as separator; by default words are matched.
    """
    return [
        *_tokens(text, as_gaps),
        CountVectorizer(
            inputCol="filtered", outputCol="features", vocabSize=vocabulary, minDF=min_df
        ),
        StringIndexer(inputCol=label, outputCol="label"),
    ]


def hash_idf_stages(
    text: str = "content", label: str = "sentiment", as_gaps: bool = False,
    buckets: int = VOCABULARY, min_df: int = MIN_DF,
) -> list:
    """Tokenise, drop stop words, hash term counts, weigh by IDF, index the label."""
    return [
        *_tokens(text, as_gaps),
        HashingTF(inputCol="filtered", outputCol="rawFeatures", numFeatures=buckets),
        IDF(inputCol="rawFeatures", outputCol="features", minDocFreq=min_df),
        StringIndexer(inputCol=label, outputCol="label"),
    ]


def fit_features(stages: Sequence, rows: DataFrame, text: str = "content",
                 fit_on: str | None = "train", split: str = "split") -> PipelineModel:
    """Fit feature stages on rows with text, by default on the training part only.

    ``fit_on=None`` fits on all rows.
    """
    known = rows.filter(F.col(text).isNotNull())
    if fit_on is not None:
        known = known.filter(F.col(split) == fit_on)
    return Pipeline(stages=list(stages)).fit(known)


def logistic_regression(**params) -> LogisticRegression:
    settings = {"maxIter": LR_ITERATIONS, "regParam": LR_REG, "elasticNetParam": 0.0} | params
    return LogisticRegression(**settings)


def naive_bayes(**params) -> NaiveBayes:
    return NaiveBayes(**({"smoothing": 1.0} | params))


def random_forest(**params) -> SparseForest:
    """Forest on rows that stay sparse; Spark ML's own holds a number per row and term."""
    return SparseForest(**({"seed": 0} | FOREST_SPARK | params))


def fits_at_once(spark: SparkSession, width: int, most: int = 4) -> int:
    """Fits of so many features whose vectors take up to half of the driver's heap; one at least."""
    heap = spark._jvm.java.lang.Runtime.getRuntime().maxMemory()
    return max(1, min(most, heap // 2 // (8 * FIT_VECTORS * max(1, width))))


def linear_svc(parallelism: int = 4, **params) -> OneVsRest:
    """Linear SVM, one class against the rest; ``parallelism`` classes are fitted at a time."""
    return OneVsRest(classifier=LinearSVC(**params), parallelism=parallelism)


def perceptron(inputs: int, hidden: int, classes: int, **params):
    """Neural classifier over pooled word vectors."""
    return MultilayerPerceptronClassifier(
        **({"layers": [inputs, hidden, classes], "seed": 0} | params)
    )


@contextmanager
def kept(df: DataFrame, partitions: int | None = None) -> Iterator[DataFrame]:
    """Keep rows across the passes of iterative fits; spills to disk, recomputed if lost.

    Every iteration starts a task per partition; a caller who knows that the rows are few
    may ask for few ``partitions``.
    """
    rows = df if partitions is None else df.coalesce(partitions)
    cached = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield cached
    finally:
        cached.unpersist()


def wide_partitions(rows: DataFrame, features: str = "features") -> int:
    """Partitions for fits with very many features: one per core, or more if they would get large.

    Each iteration sends a number per feature and partition, so that partitions beyond the
    cores only add to what is sent.
    """
    entries = rows.agg(F.sum(F.size(F.unwrap_udt(features)["values"]))).first()[0] or 0
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-entries // PARTITION_ENTRIES))


def fit_kept(estimator: Estimator, rows: DataFrame, partitions: int | None = None) -> Model:
    """Fit on rows that stay cached for the duration of the fit only."""
    with kept(rows, partitions) as cached:
        return estimator.fit(cached)


def evaluator(metric: str = "f1") -> MulticlassClassificationEvaluator:
    return MulticlassClassificationEvaluator(predictionCol="prediction", metricName=metric)


def tune(train: DataFrame, fold: str, folds: int = CV_FOLDS, parallelism: int = 4,
         **params) -> CrossValidatorModel:
    """Cross-validated grid of ridge strength and elastic-net share; best model refitted.

    ``fold`` is a column with the fold of each row, so folds do not depend on partitioning.
    """
    lr = logistic_regression(**params)
    grid = (
        ParamGridBuilder()
        .addGrid(lr.regParam, GRID_REG)
        .addGrid(lr.elasticNetParam, GRID_ELASTIC)
        .build()
    )
    cv = CrossValidator(
        estimator=lr, estimatorParamMaps=grid, evaluator=evaluator(), numFolds=folds,
        foldCol=fold, parallelism=parallelism,
    )
    return fit_kept(cv, train)


def grid_results(model: CrossValidatorModel, spark: SparkSession) -> DataFrame:
    """``(reg, elastic_net, f1)``: one row per grid point."""
    rows = []
    for params, value in zip(model.getEstimatorParamMaps(), model.avgMetrics, strict=True):
        named = {p.name: v for p, v in params.items()}
        rows.append((named["regParam"], named["elasticNetParam"], float(value)))
    return spark.createDataFrame(rows, "reg double, elastic_net double, f1 double")


def compare_models(
    rows: DataFrame, estimators: dict[str, Estimator], fold: str, folds: int = CV_FOLDS
) -> DataFrame:
    """``(model_name, fold_idx, accuracy)``: every model on every fold.

    Rows need ``features``, ``label`` and ``fold``. Each fit and each score is one
    distributed job; only the finished accuracies reach the driver.
    """
    spark = rows.sparkSession
    entries = []
    with kept(rows, wide_partitions(rows)) as cached:
        for name, estimator in estimators.items():
            for i in range(folds):
                model = estimator.fit(cached.filter(F.col(fold) != i))
                scored = model.transform(cached.filter(F.col(fold) == i))
                hit = scored.agg(
                    F.avg((F.col("prediction") == F.col("label")).cast("double"))
                ).first()[0]
                entries.append((name, i, hit))
    return spark.createDataFrame(entries, "model_name string, fold_idx int, accuracy double")


def label_names(predictions: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Add ``predicted``: the label name of each prediction."""
    return IndexToString(
        inputCol="prediction", outputCol="predicted", labels=list(labels)
    ).transform(predictions)


def label_order(features: PipelineModel) -> list[str]:
    """Label names in index order."""
    for stage in features.stages:
        if isinstance(stage, StringIndexerModel):
            return list(stage.labels)
    raise ValueError("no label index among the stages")


def score_texts(features: PipelineModel, model: Model, texts: DataFrame,
                label: str = "sentiment") -> DataFrame:
    """Predicted label names of unlabelled texts, through the fitted stages."""
    stages = [s for s in features.stages if not isinstance(s, StringIndexerModel)]
    scored = model.transform(PipelineModel(stages).transform(texts))
    named = label_names(scored, label_order(features))
    return named.withColumnRenamed("predicted", f"predicted_{label}")


def steps_metrics(models: Sequence[Model], rows: DataFrame, split: str = "split") -> DataFrame:
    """``(step, series, loss, accuracy)`` of models after steps 1, 2, ..., on the parts
    ``train`` and, for the rest, ``dev``.

    All models score a row in the same scan.
    """
    scored = rows.select(F.col(split).alias("_split"), "features", "label")
    sums = []
    for i, model in enumerate(models):
        named = model.copy().setRawPredictionCol(f"_raw{i}").setProbabilityCol(f"_prob{i}").setPredictionCol(f"_pred{i}")
        scored = named.transform(scored).drop(f"_raw{i}")
        own = F.element_at(vector_to_array(f"_prob{i}"), F.col("label").cast("int") + 1)
        sums += [
            F.avg(-F.log(F.greatest(own, F.lit(1e-15)))).alias(f"loss{i}"),
            F.avg((F.col(f"_pred{i}") == F.col("label")).cast("double")).alias(f"accuracy{i}"),
        ]
    series = F.when(F.col("_split") == "train", "train").otherwise("dev")
    steps = F.array(*[
        F.struct(F.lit(i + 1).cast("long").alias("step"), F.col(f"loss{i}").alias("loss"), F.col(f"accuracy{i}").alias("accuracy"))
        for i in range(len(models))
    ])
    return scored.groupBy(series.alias("series")).agg(*sums).select("series", F.inline(steps)).select(
        "step", "series", "loss", "accuracy"
    )


def coefficients(model, terms: DataFrame, labels: Sequence[str]) -> DataFrame:
    """``(label, term, weight)`` of a linear model over ``(term, term_id)``.

    The weights of one class against the rest are read from the files of the saved model,
    other models hand over one array per class: none goes through the driver one by one.
    """
    spark = terms.sparkSession
    if isinstance(model, Model) and hasattr(model, "models"):
        path = new_path(spark, "linear-model")
        model.write().save(path)
        parts = [
            spark.read.parquet(f"{path}/model_{k}/data").select(
                F.lit(labels[k]).alias("label"), vector_to_array("coefficients").alias("w")
            )
            for k in range(len(model.models))
        ]
        rows = parts[0]
        for more in parts[1:]:
            rows = rows.union(more)
    else:
        matrix = model.coefficientMatrix.toArray()
        arrays = [-matrix[0], matrix[0]] if len(matrix) == 1 else list(matrix)
        rows = spark.createDataFrame(
            [(labels[k], a.tolist()) for k, a in enumerate(arrays)], "label string, w array<double>"
        )
    weights = rows.select("label", F.posexplode("w").alias("term_id", "weight"))
    return weights.join(terms.select("term", "term_id"), "term_id")

"""Readers for the input formats: CSV tables, label-by-directory files, word vectors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.functions.text import file_lines, review_words
from labelloom.storage import setting

_LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"

# The columns of the labelled-tweet table.
TWEET_SCHEMA = T.StructType(
    [
        T.StructField("tweet_id", T.LongType()),
        T.StructField("sentiment", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("content", T.StringType()),
    ]
)


def read_labelled_csv(
    spark: SparkSession, path: str, schema: T.StructType = TWEET_SCHEMA,
    multi_line: bool = False,
) -> DataFrame:
    """Headered CSV, columns found by name and cast to ``schema``; no inference pass.

    Quotes are escaped by doubling. With ``multi_line`` quoted fields may span lines; a
    file is then one task, however large.
    """
    raw = spark.read.options(header=True, quote='"', escape='"', multiLine=multi_line).csv(path)
    return raw.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def read_labelled_csv_not_null(
    spark: SparkSession, path: str, text: str = "content", schema: T.StructType = TWEET_SCHEMA,
    multi_line: bool = False,
) -> DataFrame:
    """The same, without rows whose text is missing or empty."""
    df = read_labelled_csv(spark, path, schema, multi_line)
    return df.filter(F.col(text).isNotNull() & (F.col(text) != ""))


def read_numeric_lines(
    spark: SparkSession, path: str, features: Sequence[str], label: str = "label"
) -> DataFrame:
    """Headerless CSV of numbers with the label in the last column; blank rows dropped."""
    schema = T.StructType(
        [T.StructField(c, T.DoubleType()) for c in features]
        + [T.StructField(label, T.LongType())]
    )
    return spark.read.schema(schema).csv(path).dropna("all")


def read_labelled_files(spark: SparkSession, roots: Mapping[str, Sequence[str]]) -> DataFrame:
    """``(path, text, label)``: one row per file two levels below a root.

    ``roots`` maps a label to its corpus roots. Files lying directly in a root are not
    part of the corpus. They are listed by a few tasks a core: Spark would start one for each.
    """
    parts = []
    for label, folders in roots.items():
        globs = [f"{folder.rstrip('/')}/*/*" for folder in folders]
        with setting(spark, _LISTING_TASKS, 4 * spark.sparkContext.defaultParallelism):
            files = spark.read.text(globs, wholetext=True)
        parts.append(
            files.select(
                F.col("_metadata.file_path").alias("path"),
                F.col("value").alias("text"),
                F.lit(label).alias("label"),
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def lines_of(files: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``(key, line_no, line, words, n_words)``: cleaned words of every line.

    A blank line has one empty word.
    """
    lines = files.select(key, F.posexplode(file_lines(F.col(text))).alias("line_no", "line"))
    words = F.when(
        F.col("line") == "", F.array(F.lit(""))
    ).otherwise(review_words(F.col("line"), faithful=True))
    return lines.withColumn("words", words).withColumn("n_words", F.size("words"))


def read_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """``(word, vector)`` from text lines ``word x1 x2 ...``; a size header is skipped."""
    fields = spark.read.text(path).select(F.split("value", " ").alias("f"))
    return fields.filter(F.size("f") > 2).select(
        F.element_at("f", 1).alias("word"),
        F.slice("f", F.lit(2), F.size("f") - 1).cast("array<float>").alias("vector"),
    )


def inline_rows(spark: SparkSession, texts: Sequence[str]) -> DataFrame:
    """``(doc_id, content)`` from a few literal strings."""
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, content string")


def drop_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.drop(*names)


def select_renamed(df: DataFrame, columns: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Columns in the given order under new names."""
    return df.select(*columns).toDF(*names)


def split_features(df: DataFrame) -> DataFrame:
    """``(*id columns, features, label)``: the last column is the label."""
    *features, label = df.columns
    return df.select(
        F.array(*[F.col(c).cast("double") for c in features]).alias("features"),
        F.col(label).alias("label"),
    )


def split_fields(lines: DataFrame, value: str = "value") -> DataFrame:
    """``(features, label)`` of text rows ``x1,x2,...,y``; rows of fewer than two fields go."""
    fields = lines.withColumn("_f", F.split(value, ","))
    rows = fields.filter(F.size("_f") > 1)
    return rows.select(
        *[c for c in lines.columns if c != value],
        F.slice("_f", F.lit(1), F.size("_f") - 1).cast("array<double>").alias("features"),
        F.element_at("_f", -1).alias("label"),
    )

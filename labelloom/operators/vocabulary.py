"""Term counts, vocabularies and document encodings in long form."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from labelloom.functions.arrays import pad_left, pad_right
from labelloom.operators.blocks import block_lookup, repeats, row_blocks, term_blocks
from labelloom.operators.keyed import hash_rank
from labelloom.storage import written


def run_starts(values: str, field: str = "") -> Column:
    """Positions in a sorted array at which a new value (of ``field``) starts."""
    return F.expr(
        f"CASE WHEN size({values}) > 0 THEN filter(sequence(0, size({values}) - 1), "
        f"i -> i = 0 or {values}[i]{field} <> {values}[i - 1]{field}) ELSE array() END"
    )


def _runs(df: DataFrame, tokens: str, keep: tuple[str, ...]) -> DataFrame:
    return df.select(*keep, F.sort_array(tokens).alias("_s")).withColumn("_at", run_starts("_s"))


def _run_entries(term: str) -> str:
    return (
        "transform(_at, (p, j) -> struct("
        f"_s[p] as {term}, cast(coalesce(get(_at, j + 1), size(_s)) - p as long) as tf))"
    )


def document_terms(df: DataFrame, tokens: str, *keep: str) -> DataFrame:
    """``(*keep, terms)``: a row's distinct tokens in order, as ``(term, tf)``; to be written.

    Counted inside the row by sorting its tokens and measuring the runs, so counting
    needs no shuffle.
    """
    return _runs(df, tokens, keep).select(*keep, F.expr(_run_entries("term")).alias("terms"))


def term_counts(df: DataFrame, tokens: str, *keep: str, term: str = "term") -> DataFrame:
    """``(*keep, term, tf)``: one row per distinct token of each row.

    The runs unfold where they are measured: a filter that Spark infers for the unfolding
    would otherwise measure them a second time, token by token.
    """
    return _runs(df, tokens, keep).select(*keep, F.expr(f"inline({_run_entries(term)})"))


def distinct_words(df: DataFrame, tokens: str, seed: object = "word") -> DataFrame:
    """``(word, uses, word_id)``: ids 1, 2, ... in hash order of the word; 0 is padding.

    The order of ids is arbitrary in a set of words; hash order makes it reproducible and
    lets the ids be given out in parallel.
    """
    words = (
        term_counts(df, tokens, term="word").groupBy("word").agg(F.sum("tf").alias("uses"))
    )
    # Written first: ranking reads it twice and must not tokenise the corpus twice.
    return written(
        hash_rank(written(words, "words"), "word", seed, name="word_id"), "vocabulary"
    )


def top_words(df: DataFrame, key: str, tokens: str, num_words: int = 2000) -> DataFrame:
    """``(word, uses, word_id)`` of the ``num_words - 1`` most used words, ids from 1.

    Equally frequent words are ranked by first appearance in key order.
    """
    # Per row: each distinct word once, with its count and first position.
    pairs = F.transform(F.col(tokens), lambda w, i: F.struct(w.alias("w"), i.alias("p")))
    per_row = (
        df.select(F.col(key).alias("_k"), F.sort_array(pairs).alias("_e"))
        .withColumn("_at", run_starts("_e", ".w"))
        .select(
            "_k",
            F.expr(
                "inline(transform(_at, (a, j) -> struct(_e[a].w as word, _e[a].p as p, "
                "cast(coalesce(get(_at, j + 1), size(_e)) - a as long) as tf)))"
            ),
        )
    )
    # Key and position packed into one decimal: a fixed-width buffer keeps the
    # aggregation hash-based, which a struct would not.
    first = F.col("_k").cast("decimal(20,0)") * F.lit(2**31).cast("decimal(10,0)") + F.col(
        "p"
    ).cast("decimal(10,0)")
    ranked = (
        per_row.groupBy("word")
        .agg(F.sum("tf").alias("uses"), F.min(first).alias("_first"))
        .orderBy(F.desc("uses"), "_first")
        .limit(num_words - 1)
    )
    # At most num_words - 1 rows are left for this window.
    order = W.orderBy(F.desc("uses"), "_first")
    return written(
        ranked.select("word", "uses", F.row_number().over(order).alias("word_id")), "top-words"
    )


def document_frequency(counts: DataFrame, term: str = "term") -> DataFrame:
    """``(term, df, uses)`` from term counts."""
    return counts.groupBy(term).agg(F.count("*").alias("df"), F.sum("tf").alias("uses"))


def frequent_terms(counts: DataFrame, size: int = 10_000, min_df: int = 5) -> DataFrame:
    """``(term, df, uses, term_id)`` of the most used terms, ids from 0; ties by term."""
    top = (
        document_frequency(counts)
        .filter(F.col("df") >= min_df)
        .orderBy(F.desc("uses"), "term")
        .limit(size)
    )
    # At most ``size`` rows are left for this window.
    order = W.orderBy(F.desc("uses"), "term")
    return written(top.withColumn("term_id", F.row_number().over(order) - 1), "terms")


def numbered_terms(table: DataFrame) -> DataFrame:
    """Written ``(*table, term_id)``: all terms of a fitted table, ids from 0 in hash order."""
    ranked = hash_rank(table, "term", "term", name="term_id")
    return written(ranked.withColumn("term_id", F.col("term_id") - 1), "term-ids")


def fit_terms(counts: DataFrame) -> DataFrame:
    """Written ``(term, df, uses)`` of all terms, without limits."""
    return written(document_frequency(counts), "terms")


def restrict(counts: DataFrame, terms: DataFrame) -> DataFrame:
    """``(..., term, tf)``: the counts of known terms, looked up block by block.

    ``counts`` are documents with ``terms`` as ``document_terms`` makes them, or long rows.
    """
    keep = [c for c in counts.columns if c not in ("terms", "term", "tf")]
    entry = counts.schema["terms"].dataType.elementType if "terms" in counts.columns else counts.schema
    schema = StructType([*[counts.schema[c] for c in keep], entry["term"], entry["tf"]])

    def answer(block: dict, found: pa.Table) -> list:
        sizes = block["sizes"].to_numpy(zero_copy_only=False)
        row, places = np.repeat(np.arange(len(sizes)), sizes), block["ids"].to_numpy(zero_copy_only=False)
        held = np.zeros(len(block["words"]) + 1, bool)  # the last place is that of NULL
        held[found["at"].to_numpy()] = True
        known = held[places]
        at = pa.array(row[known])
        return [
            *[c.take(at) for c in block["rows"].flatten()], block["words"].take(pa.array(places[known])),
            block["counts"].filter(pa.array(known)),
        ]

    return block_lookup(term_blocks(counts, keep), terms.select("term", "df"), "term", "df", answer, schema)


def id_summary(docs: DataFrame, key: str, vocabulary: DataFrame) -> DataFrame:
    """``(key, tokens, id_sum, id_min, id_max)`` of the known words of ``(key, terms)``, per key.

    Keys without any are left out.
    """
    names = ("tokens", "id_sum", "id_min", "id_max")
    ids = vocabulary.schema["word_id"].dataType
    kinds = (LongType(), LongType(), ids, ids)
    schema = StructType([
        StructField(key, docs.schema[key].dataType), *[StructField(c, k) for c, k in zip(names, kinds, strict=True)]
    ])

    def answer(block: dict, found: pa.Table) -> list:
        sizes = block["sizes"].to_numpy(zero_copy_only=False)
        row, places = np.repeat(np.arange(len(sizes)), sizes), block["ids"].to_numpy(zero_copy_only=False)
        ids, held = np.zeros(len(block["words"]) + 1, np.int64), np.zeros(len(block["words"]) + 1, bool)
        ids[found["at"].to_numpy()] = found["word_id"].to_numpy()
        held[found["at"].to_numpy()] = True
        known = held[places]
        row, word = row[known], ids[places[known]]
        tf = block["counts"].to_numpy(zero_copy_only=False)[known].astype(np.int64)
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        if not len(starts):
            return [block["rows"].field(0).slice(0, 0), *[pa.array([], pa.int64()).cast(found["word_id"].type if i > 1 else pa.int64()) for i in range(4)]]
        summed = [np.add.reduceat(tf, starts), np.add.reduceat(tf * word, starts)]
        ends = [pa.array(f.reduceat(word, starts)).cast(found["word_id"].type) for f in (np.minimum, np.maximum)]
        return [block["rows"].field(0).take(pa.array(row[starts])), *[pa.array(v) for v in summed], *ends]

    per_row = block_lookup(term_blocks(docs, [key]), vocabulary.select(F.col("word").alias("term"), "uses", "word_id"), "term", "uses", answer, schema)
    return per_row.groupBy(key).agg(
        F.sum("tokens").alias("tokens"), F.sum("id_sum").alias("id_sum"), F.min("id_min").alias("id_min"), F.max("id_max").alias("id_max")
    )


def encode_known(df: DataFrame, key: str, tokens: str, vocabulary: DataFrame) -> DataFrame:
    """``(key, ids)``: ids of the words in the vocabulary, other words left out.

    Rows without any known word have an empty list. Words are looked up block by block. Rows
    that share a key become one, by position.
    """
    kind = df.schema[key].dataType
    schema = StructType([StructField(key, kind), StructField("_found", ArrayType(IntegerType()))])

    def answer(block: dict, found: pa.Table) -> list:
        ids = np.full(len(block["words"]) + 1, -1, np.int64)
        ids[found["at"].to_numpy()] = found["word_id"].to_numpy()
        hits = np.zeros(len(ids), bool)
        hits[found["at"].to_numpy()] = True
        places = block["ids"].to_numpy(zero_copy_only=False)  # -1 is the last place, which nobody has
        values = pa.array(ids[places].astype(np.int32), mask=~hits[places])
        offsets = np.concatenate([[0], np.cumsum(block["sizes"].to_numpy(zero_copy_only=False))])
        return [block["rows"].field(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)]

    coded = block_lookup(
        row_blocks(df, [key], tokens), vocabulary.select("word", "uses", "word_id"), "word", "uses", answer, schema
    )
    if not repeats(df, [key]):
        return coded.select(key, F.filter("_found", lambda v: v.isNotNull()).alias("ids"))
    rows = coded.groupBy(key).agg(F.collect_list("_found").alias("_l"))
    places = F.flatten(F.transform("_l", lambda l: F.transform(l, lambda v, p: F.struct(p.alias("p"), v.alias("v")))))
    merged = F.transform(F.array_sort(F.filter(places, lambda e: e["v"].isNotNull())), lambda e: e["v"])
    alone = F.filter(F.get("_l", F.lit(0)), lambda v: v.isNotNull())
    return rows.select(key, F.when(F.size("_l") == 1, alone).otherwise(merged).alias("ids"))


def encode_fixed(
    df: DataFrame, key: str, tokens: str, vocabulary: DataFrame, length: int = 160
) -> DataFrame:
    """``(key, ids)``: ids of the first ``length`` words, zero-padded on the right.

    The fixed length is the shape of the result; the vocabulary covers whole documents.
    """
    head = df.select(key, F.slice(tokens, 1, length).alias("_t"))
    found = encode_known(head, key, "_t", vocabulary)
    return found.select(key, pad_right(F.col("ids"), length).alias("ids"))


def kept_sequences(encoded: DataFrame) -> DataFrame:
    """Encoded documents written once, for operators that read them twice."""
    return written(encoded, "sequences")


def pad_to_longest(df: DataFrame, ids: str = "ids") -> DataFrame:
    """Left-pad every id list to the length of the longest one."""
    longest: Column = df.select(F.max(F.size(ids)).alias("m")).scalar()
    return df.withColumn(ids, pad_left(F.col(ids), longest))

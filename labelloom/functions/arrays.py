"""Fixed-size arrays: one-hot labels, padding, chunks, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _zeros(size: Column) -> Column:
    return F.array_repeat(F.lit(0), F.greatest(size, F.lit(0)).cast("int"))


def one_hot_binary(is_first: Column) -> Column:
    return F.when(is_first, F.array(F.lit(1), F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))


def one_hot(value: Column, classes: Column) -> Column:
    """0/1 per class; ``classes`` is an array column, usually a scalar subquery."""
    return F.transform(classes, lambda c: (c == value).cast("int"))


def pad_right(ids: Column, length: int) -> Column:
    """Cut to ``length`` entries and fill up with the padding id 0."""
    cut = F.slice(ids, 1, length)
    return F.concat(cut, _zeros(F.lit(length) - F.size(cut)))


def pad_left(ids: Column, length: Column) -> Column:
    return F.concat(_zeros(length - F.size(ids)), ids)


def chunk(ids: Column, chunks: int, width: int) -> Column:
    """Cut a fixed-length array into ``chunks`` rows of ``width``."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(chunks - 1)),
        lambda i: F.slice(ids, i * width + 1, F.lit(width)),
    )


def argmax(scores: Column) -> Column:
    """Position of the highest score, counted from 0; the first one wins a tie."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def cross_entropy(scores: Column, label: Column) -> Column:
    """Softmax cross-entropy of raw scores against an integer label."""
    top = F.array_max(scores)
    total = F.aggregate(scores, F.lit(0.0), lambda acc, s: acc + F.exp(s - top))
    return F.log(total) + top - F.element_at(scores, label.cast("int") + 1)


def cross_entropy_one_hot(scores: Column, target: Column) -> Column:
    """The same loss against a one-hot (or soft) target array."""
    top = F.array_max(scores)
    total = F.aggregate(scores, F.lit(0.0), lambda acc, s: acc + F.exp(s - top))
    picked = F.aggregate(
        F.zip_with(scores, target, lambda s, t: s * t), F.lit(0.0), lambda acc, x: acc + x
    )
    mass = F.aggregate(target, F.lit(0.0), lambda acc, t: acc + t)
    return (F.log(total) + top) * mass - picked

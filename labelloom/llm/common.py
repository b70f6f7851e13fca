"""What the operators of this package share: words, sizes, ordered parts, hot keys."""

from __future__ import annotations

import io
import math
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyarrow import fs
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import labelloom
from labelloom.storage import new_path

# Words are runs of characters other than space, tab, line feed, vertical tab, form feed
# and carriage return; all other characters belong to words.
WORD_GAP = r"[\x20\x09-\x0D]+"
# Text of one part, in bytes: a task holds a few times this.
PART_BYTES = 8_000_000
# Steps of the quantiles that bound the parts; beyond, parts only get less even.
_ACCURACY = 200_000


class Memory(dict[str, bytes]):
    """What was made of texts: what is not known yet is looked up in an older memory, then made.

    Only texts of up to ``longest`` letters are remembered.
    """

    def __init__(self, make: Callable[[str], bytes], size: int, longest: int, older: dict[str, bytes] | None = None):
        self._make, self._size, self._longest, self._older = make, size, longest, older or {}

    def __missing__(self, text: str) -> bytes:
        found = self._older.get(text)
        if found is None:
            found = self._make(text)
        if len(text) <= self._longest:
            self[text] = found
        return found

    @property
    def older(self) -> dict[str, bytes]:
        """The memory in front of which this one stands."""
        return self._older

    def renewed(self) -> Memory:
        """This memory, or an empty one in front of it if it is full."""
        return self if len(self) < self._size else Memory(self._make, self._size, self._longest, dict(self))

    def forget(self) -> None:
        self.clear()
        self._older = {}


def words(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def part_count(docs: DataFrame, text: str = "text", part_bytes: int | None = None) -> int:
    """Number of parts of about ``part_bytes`` that the texts make; 1 at least."""
    total = docs.agg(F.sum(F.octet_length(F.col(text)) + 64).alias("b")).first()["b"] or 0
    return max(1, math.ceil(total / (part_bytes or PART_BYTES)))


def ordered_parts(
    docs: DataFrame, key: str = "doc_id", text: str = "text", part_bytes: int | None = None
) -> tuple[DataFrame, int]:
    """Add ``part``: 0, 1, ... in the order of ``key``, each with about as many rows.

    The boundaries are quantiles of the key, one number per part on the driver, as in a
    range partitioning; they are fixed here so that every later plan sees the same parts.
    Equal keys share a part; null keys are in part 0. Returns the number of parts as well.
    """
    n = part_count(docs, text, part_bytes)
    cuts: list[float] = []
    if n > 1:
        shares = [i / n for i in range(1, n)]
        accuracy = min(10 * n, _ACCURACY)
        found = docs.agg(F.percentile_approx(key, shares, accuracy).alias("q")).first()["q"]
        cuts = sorted({float(q) for q in found or []})
    if not cuts:
        return docs.withColumn("part", F.lit(0)), 1
    # Bisection in a fixed list. As doubles, keys keep their order.
    placed = Bucketizer(
        splits=[-math.inf, *cuts, math.inf], inputCol="_v", outputCol="_part", handleInvalid="keep"
    ).transform(docs.withColumn("_v", F.col(key).cast("double")))
    part = F.when(F.col(key).isNull(), 0).otherwise(F.col("_part").cast("int"))
    return placed.withColumn("part", part).drop("_v", "_part"), len(cuts) + 1


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let the Python workers of all executors import this package.

    The package goes as an archive to the shared folder and from there to the executors,
    once per application.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    target = new_path(spark, "package", lasting=True) + ".zip"
    root = Path(labelloom.__file__).parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, str(file.relative_to(root.parent)))
    system, path = filesystem(target)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(path) as sink:
        sink.write(packed.getvalue())
    context.addPyFile(target)
    _shipped.add(context.applicationId)


def filesystem(path: str):
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")

"""WARC archives: written with revisit records, read back by verified record boundaries.

Writing uses Spark's text writer: a record is one string, the blank line behind it the line
separator. Reading cuts the files, in splits of any size, wherever the version line stands.
Each piece is a candidate record, and its header says where its successor should begin. A
version line inside a payload gives a false candidate, so candidates are verified: chains
of successors are followed from the start of each file, and only what they reach is a
record. Inside a zone of a file a task follows all chains at once by pointer jumping (each
step doubles the distance) and reports where every candidate leaves the zone; across zones
the reports are joined the same way.

Defined cases: a null page has an empty payload; a null id is written as ``none`` and read
as null; line breaks in URLs are dropped; rows that repeat an id are records of their own,
and all rows with the largest id of equal payloads are responses. Extra columns are ignored.
"""

from __future__ import annotations

from datetime import UTC, datetime

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelloom.llm.common import ship
from labelloom.plans.registry import query
from labelloom.storage import new_path, written

VERSION = "WARC/1.0\r\n"
BLANK = "\r\n\r\n"
# What a revisit record is, by the standard.
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
# Payloads shorter than this are always written in full.
LEAST_REVISIT = 1000
# Bytes of a file whose candidates one task follows.
ZONE_BYTES = 64_000_000
FILE_RECORDS = 50_000
SALTS = 16


def revisits(pages: DataFrame) -> DataFrame:
    """``(page_id, digest, refers_to)`` of the pages that a later equal one stands for."""
    sums = pages.select("page_id", "digest", "payload_bytes").filter(F.col("payload_bytes") >= LEAST_REVISIT)
    # Copies are counted before they move; the few groups are then repeated per salt, so
    # that a payload in a third of all pages is looked up by many tasks.
    groups = (
        sums.groupBy("digest", "payload_bytes").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
        .filter("n > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).drop("n")
    )
    return (
        sums.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
        .join(groups, ["digest", "payload_bytes", "salt"])
        .filter("page_id < refers_to").select("page_id", "digest", "refers_to").distinct()
    )


def write_archive(pages: DataFrame, folder: str, date: datetime | None = None) -> None:
    """One record per row of ``pages (page_id, url, html)``, all of one ``date``, now by default."""
    stamp = (date or datetime.now(UTC)).astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(
        "page_id", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "").alias("url"),
        F.coalesce("html", F.lit("")).alias("html"), F.sha1(payload).alias("digest"),
        F.octet_length(payload).alias("payload_bytes"),
    )
    known = written(revisits(rows), "revisits")
    marked = rows.join(known, ["page_id", "digest"], "left")
    again = F.col("refers_to").isNotNull()
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    line = lambda label, value: F.concat(F.lit(label + ": "), value, F.lit("\r\n"))
    record = F.concat(
        F.lit(VERSION),
        line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", name("page_id")),
        line("WARC-Date", F.lit(stamp)),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        line("X-Payload-Bytes", F.col("payload_bytes").cast("string")),
        F.when(again, F.concat(line("WARC-Refers-To", name("refers_to")), line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        F.lit("Content-Type: text/html\r\n"),
        F.lit("Content-Length: "), F.when(again, F.lit("0")).otherwise(F.col("payload_bytes").cast("string")),
        F.lit(BLANK),
        F.when(again, F.lit("")).otherwise(F.col("html")),
    )
    marked.select(record.alias("value")).write.option("lineSep", BLANK).option(
        "maxRecordsPerFile", FILE_RECORDS
    ).text(folder)


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Text between version lines, with file, split and reading order."""
    return spark.read.option("lineSep", VERSION).text(folder).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("seq"),
    )


def _header(header, label: str):
    found = F.regexp_extract(header, rf"(?i)(?:^|\r\n){label}: *([^\r\n]*)", 1)
    return F.when(found != "", found)


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Written table of all pieces: place, successor, header fields and payload digest.

    ``offset`` is where the piece's version line begins, ``next`` where the successor should.
    """
    header = F.substring_index("value", BLANK, 1)
    parsed = written(
        _pieces(spark, folder)
        .withColumn("header", header)
        .withColumn("head", F.octet_length("header") + 4)
        .withColumn("size", F.octet_length("value").cast("long"))
        .withColumn("length", _header(F.col("header"), "Content-Length").try_cast("long"))
        # A header must end inside its own piece.
        .withColumn("length", F.when(F.col("head") <= F.col("size"), F.col("length")))
        .withColumn("whole", F.coalesce(F.col("head") + F.col("length") + 4 == F.col("size"), F.lit(False)))
        .select(
            "file", "split", "seq", "size", "head", "length", "whole",
            _header(F.col("header"), "WARC-Type").alias("record_type"),
            _header(F.col("header"), "WARC-Record-ID").alias("record_id"),
            _header(F.col("header"), "WARC-Refers-To").alias("refers_to"),
            _header(F.col("header"), "WARC-Payload-Digest").alias("said_digest"),
            _header(F.col("header"), "X-Payload-Bytes").try_cast("long").alias("said_bytes"),
            F.when(F.col("whole"), F.sha1(F.substring(F.col("value").cast("binary"), F.col("head") + 1, F.col("length").cast("int")))).alias("digest"),
        ),
        "archive-pieces",
    )
    mark = len(VERSION)
    in_split = W.partitionBy("file", "split").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    in_file = W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    splits = parsed.groupBy("file", "split").agg(F.sum(F.col("size") + mark).alias("n")).select(
        "file", "split", F.coalesce(F.sum("n").over(in_file), F.lit(0)).alias("before")
    )
    return (
        parsed.join(splits, ["file", "split"])
        .withColumn("inside", F.coalesce(F.sum(F.col("size") + mark).over(in_split), F.lit(0)))
        # What stands before the first version line of a file is no candidate: offset below 0.
        .withColumn("offset", F.col("before") + F.col("inside") - mark)
        .withColumn("next", F.when(F.col("offset") >= 0, F.col("offset") + mark + F.col("head") + F.col("length") + 4))
        .drop("before", "inside")
    )


def _jumps(offset: np.ndarray, following: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of each successor inside the zone (else its own), and where those others lead."""
    place = np.searchsorted(offset, following)
    inside = place < len(offset)
    inside[inside] = offset[place[inside]] == following[inside]
    own = np.arange(len(offset))
    return np.where(inside, place, own), np.where(~inside & (following >= end), following, -1)


def _columns(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, int]:
    table = table.sort_by("offset")
    return table, table.column("offset").to_numpy(), table.column("next").to_numpy(), table.column("end")[0].as_py()


def _exits(table: pa.Table) -> pa.Table:
    table, offset, following, end = _columns(table)
    jump, leads = _jumps(offset, following, end)
    while True:
        further = jump[jump]
        if np.array_equal(further, jump):
            break
        jump = further
    return pa.table({"file": table.column("file"), "offset": offset, "exit": leads[jump]})


def _reached(table: pa.Table) -> pa.Table:
    table, offset, following, end = _columns(table)
    jump, _ = _jumps(offset, following, end)
    reached = offset == table.column("entry")[0].as_py()
    for _ in range(max(1, math.ceil(math.log2(len(offset) + 1)))):
        reached[jump[reached]] = True
        jump = jump[jump]
    return table.select(["file", "offset"]).filter(pa.array(reached))


def reachable(found: DataFrame, zone_bytes: int = ZONE_BYTES) -> DataFrame:
    """``(file, offset)`` of the candidates on the chains from the files' starts."""
    zone = F.floor(F.col("offset") / zone_bytes).cast("long")
    ship(found.sparkSession)
    links = found.filter("next is not null").select("file", zone.alias("zone"), "offset", "next").withColumn(
        "end", (F.col("zone") + 1) * zone_bytes
    )
    exits = written(
        links.groupBy("file", "zone").applyInArrow(_exits, "file string, offset bigint, exit bigint").filter("exit >= 0 or offset = 0"),
        "zone-exits",
    )
    zones = links.agg(F.max("zone")).first()[0] or 0
    entries = exits.filter("offset = 0").select("file", "offset")
    # Only where a chain leaves a zone can another one be entered.
    jumps = exits.join(
        exits.select("file", F.col("exit").alias("offset")).union(entries).distinct(), ["file", "offset"]
    )
    for _ in range(math.ceil(math.log2(zones + 1))):
        jumps = written(jumps, "jumps")
        entries = written(
            entries.union(entries.join(jumps, ["file", "offset"]).select("file", F.col("exit").alias("offset"))).distinct(),
            "entries",
        )
        jumps = jumps.join(
            jumps.select("file", F.col("offset").alias("exit"), F.col("exit").alias("_exit")), ["file", "exit"]
        ).select("file", "offset", F.col("_exit").alias("exit"))
    first = entries.select("file", F.col("offset").alias("entry"), zone.alias("zone"))
    return links.join(first, ["file", "zone"]).groupBy("file", "zone").applyInArrow(_reached, "file string, offset bigint")


def read_archive(spark: SparkSession, folder: str, zone_bytes: int = ZONE_BYTES) -> DataFrame:
    """Header fields, payload length and payload digest of every verified record."""
    found = written(candidates(spark, folder), "archive-candidates")
    good = written(reachable(found, zone_bytes), "archive-records").withColumn("good", F.lit(True))
    placed = found.join(good, ["file", "offset"], "left")
    whole = placed.filter("good and whole")
    # A payload with version lines in it came in several pieces; they belong to the last
    # record before them and are read once more.
    before = W.partitionBy("file").orderBy("offset").rowsBetween(W.unboundedPreceding, W.currentRow)
    owned = placed.withColumn(
        "owner", F.last(F.when(F.col("good"), F.struct("offset", "whole")), ignorenulls=True).over(before)
    )
    parts = written(
        owned.filter("not owner.whole").select("file", "split", "seq", "offset", F.col("owner.offset").alias("owner")),
        "archive-parts",
    )
    texts = (
        _pieces(spark, folder).join(parts, ["file", "split", "seq"])
        .groupBy("file", "owner").agg(F.sort_array(F.collect_list(F.struct("offset", "value"))).alias("all"))
        .select("file", F.col("owner").alias("offset"), F.array_join(F.col("all.value"), VERSION).cast("binary").alias("bytes"))
    )
    split = placed.filter("good and not whole").join(texts, ["file", "offset"]).withColumn(
        "digest", F.sha1(F.substring("bytes", F.col("head") + 1, F.col("length").cast("int")))
    ).drop("bytes")
    return whole.unionByName(split)


@query("op4_warc_round_trip")
def op4(spark, sf):
    """Records of an archive of all pages, as they are read back."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")
    folder = new_path(spark, "warc")
    write_archive(pages, folder)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    again = F.col("record_type") == "revisit"
    return read_archive(spark, folder).select(
        number("record_id").alias("page_id"),
        F.when(again, F.col("said_bytes")).otherwise(F.col("length")).cast("long").alias("payload_bytes"),
        F.when(again, F.regexp_replace("said_digest", "^sha1:", "")).otherwise(F.col("digest")).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )

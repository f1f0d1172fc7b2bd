"""JSON lines with lineage from files of any size: Spark splits the files by byte ranges, and line numbers are put together from the ranges' counts.

Lines are numbered within the range in which they begin; the lines of all ranges before it in the file are added. Both are read from the same scan, whose
ranges come from the files alone, so a number is the line's own however many tasks read the file. Ranges, not lines, are summed by file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bytes up to which the ranges' first line numbers are broadcast.
BROADCAST_BYTES = 16 << 20


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """source, line (from 1, of that file) and value of every line, blank ones too. Lines end with line feeds; a carriage return before one goes."""
    m = F.col("_metadata")
    read = spark.read.option("lineSep", "\n").text(path).select(m["file_path"].alias("source"), m["file_block_start"].alias("range"), F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("place"), "value")
    ranges = read.groupBy("source", "range", "task").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("source", "range", (before - F.col("first") + 1).alias("offset"))
    # 256 bytes a range are assumed, names of files included.
    small = sum(1 for _ in ranges.select("range").limit(BROADCAST_BYTES // 256 + 1).toLocalIterator()) <= BROADCAST_BYTES // 256
    lines = read.join(F.broadcast(ranges) if small else ranges, ["source", "range"])
    return lines.select("source", (F.col("place") + F.col("offset")).alias("line"), F.regexp_replace("value", "\r$", "").alias("value"))


def jsonl_with_lineage(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """source, line (from 1, of that file), status (ok, invalid_json) and the row as a struct, for each line that is not blank."""
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    valid = F.expr("try_parse_json(value) IS NOT NULL")
    return lines.select("source", "line", F.when(valid, "ok").otherwise("invalid_json").alias("status"), F.when(valid, F.from_json("value", schema)).alias("row"))


def status_counts(rows: DataFrame) -> DataFrame:
    """source, ok, malformed and the first malformed line of each file."""
    bad = F.col("status") != "ok"
    return rows.groupBy("source").agg(F.count(F.when(~bad, 1)).alias("ok"), F.count(F.when(bad, 1)).alias("malformed"), F.min(F.when(bad, F.col("line"))).alias("first_malformed"))


def in_sequence(rows: DataFrame) -> DataFrame:
    """rows with place: the line's number over all files, one after the other by name. Files that have no such row take no place."""
    files = rows.groupBy("source").agg(F.max("line").alias("_n"))
    files = files.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("source").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return rows.join(files, "source").withColumn("place", F.col("line") + F.col("_before")).drop("_before")

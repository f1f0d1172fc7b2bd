"""Sharding by a two-pass external shuffle, in DataFrame operations only.

Pass 1 numbers the records, writes them once and scatters them uniformly into memory-sized buckets by a seeded hash of that number,
so neither a hot key nor repeated rows make a large bucket. Pass 2 shuffles each bucket (Spark's ``shuffle`` is Fisher-Yates) and
deals the buckets' concatenation out: global position p goes to shard p mod n, slot p div n. Shard sizes in rows therefore differ by
one at most, and the slots of a shard have no gap.

The buckets' positions are added up in two steps, group by group, and each bucket has a partition of its own. No shuffle has more than ``PARTITIONS``
partitions: where there are more buckets, records are scattered in two levels, first to waves of so many buckets each, which are written apart, and
then each wave to its buckets. A bucket is shuffled by the seed of its own number, so the result is the same however many waves there are. Shards are
written bucket by bucket, so no task holds a whole shard.

Nulls anywhere, very long texts (a bucket has at least one record), repeated rows and extra columns pass through unchanged: the record is carried as one struct, so no column name can
clash. An empty table gives an empty result. Map columns are allowed.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._common import materialize

BUCKET_BYTES = 64 << 20
BUCKET_ROWS = 1 << 14
#: Partitions of a shuffle at most; as many buckets are a wave. Keys and first positions of a wave's buckets (16 bytes each) are broadcast.
PARTITIONS = 1 << 15
#: Parts of a wave, each written by one task; together no more partitions than ``PARTITIONS``.
WAVE_PARTS = 1 << 12


def scatter(records: DataFrame, size: Column, seed: int, bucket_bytes: int, bucket_rows: int) -> tuple[DataFrame, int]:
    """Records with their number and bucket; and the number of buckets, from the whole input's rows and bytes."""
    numbered = records.select(F.struct("*").alias("record"), size.cast("long").alias("bytes"), F.monotonically_increasing_id().alias("n"))
    numbered = materialize(numbered, "scatter")
    total = numbered.agg(F.count("*").alias("rows"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    buckets = max(1, math.ceil(total["bytes"] / bucket_bytes), math.ceil(total["rows"] / bucket_rows))
    return numbered.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "n"), F.lit(buckets)).cast("long")), buckets


def starts(counts: DataFrame, group: int = 1024) -> DataFrame:
    """bucket and first, the rows of the buckets before it, from bucket and rows. Only sums of groups of buckets go to the driver."""
    counts = counts.withColumn("g", F.floor(F.col("bucket") / group))
    sums, offsets, total = {r["g"]: r["rows"] for r in counts.groupBy("g").agg(F.sum("rows").alias("rows")).collect()}, [], 0
    for g in sorted(sums):
        offsets.append((g, total))
        total += sums[g]
    offsets = counts.sparkSession.createDataFrame(offsets, "g long, before long")
    inside = F.sum("rows").over(W.partitionBy("g").orderBy("bucket")) - F.col("rows")
    return counts.join(offsets, "g").select("bucket", (F.col("before") + inside).alias("first"))


def own_partitions(spark: SparkSession, buckets: int) -> DataFrame:
    """bucket and key: a number that hash partitioning sends to the bucket's own partition of as many as there are buckets."""
    keys = spark.range(32 * buckets).select(F.col("id").alias("key"), F.pmod(F.hash("id"), F.lit(buckets)).cast("long").alias("bucket"))
    return keys.groupBy("bucket").agg(F.min("key").alias("key"))  # hardly ever lacks one; its bucket then shares a partition


def _shuffled(dealt: DataFrame, first: DataFrame, lowest: int, buckets: int, seed: int) -> DataFrame:
    """first, at, r of the records of as many buckets from the lowest on, each bucket in a partition of its own."""
    by_number = lambda a, b: F.when(a["n"] < b["n"], -1).when(a["n"] > b["n"], 1).otherwise(0)
    # A partition for each bucket, and an order within it, make the seeded shuffle the same when a task runs again; Spark adds the partition's number to the seed.
    dealt = dealt.withColumn("bucket", F.col("bucket") - lowest).join(F.broadcast(own_partitions(dealt.sparkSession, buckets)), "bucket", "left")
    dealt = dealt.select(F.coalesce("key", -1 - F.col("bucket")).alias("key"), "bucket", F.struct("n", "record").alias("r"))
    whole = dealt.repartition(buckets, "key").groupBy("key", "bucket").agg(F.collect_list("r").alias("rs"))
    whole = whole.select((F.col("bucket") + lowest).alias("bucket"), F.shuffle(F.array_sort("rs", by_number), seed + lowest).alias("rs"))
    return whole.join(F.broadcast(first), "bucket").select("first", F.posexplode("rs").alias("at", "r"))


def shuffle_shards(records: DataFrame, shards: int, seed: int = 17, size: Column | None = None, bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS, partitions: int = PARTITIONS) -> DataFrame:
    """Columns record (a struct of all input columns), shard int, slot long, first long (the bucket's first slot in the shard).

    size: bytes of a record, used to size the buckets (1 where null); partitions: of a shuffle at most. The same seed and input layout give the same result, whatever the partitions.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    size = F.lit(1) if size is None else F.coalesce(size, F.lit(1))
    dealt, buckets = scatter(records, size, seed, bucket_bytes, bucket_rows)
    first = starts(dealt.groupBy("bucket").agg(F.count("*").alias("rows")))
    if buckets <= partitions:
        out = _shuffled(dealt, first, 0, buckets, seed)
    else:
        waves = -(-buckets // partitions)
        parts = min(partitions, waves * WAVE_PARTS)  # at 100 TB, 3 GB each, which pass through
        wave, part = F.floor(F.col("bucket") / partitions).alias("wave"), F.pmod(F.xxhash64(F.lit(seed + 1), "n"), F.lit(WAVE_PARTS))
        dealt = materialize(dealt.select("*", wave).repartition(parts, "wave", part), "waves", "wave")
        first = materialize(first.select("*", wave), "starts", "wave")
        of = lambda frame, w: frame.where(F.col("wave") == w).drop("wave")  # noqa: E731  one folder
        out = reduce(DataFrame.unionByName, [_shuffled(of(dealt, w), of(first, w), w * partitions, min(partitions, buckets - w * partitions), seed) for w in range(waves)])
    place = F.col("first") + F.col("at")
    part = F.ceil((F.col("first") - F.pmod(place, F.lit(shards))) / shards).cast("long")  # the bucket's first slot in this record's shard
    return out.select(F.col("r.record").alias("record"), F.pmod(place, F.lit(shards)).cast("int").alias("shard"), F.floor(place / shards).cast("long").alias("slot"), part.alias("first"))


def write_shards(records: DataFrame, path: str, shards: int, seed: int = 17, size: Column | None = None, **sizes: int) -> None:
    """The shards as Parquet under path/shard=K/first=S: each bucket's part of a shard is a file of its own, from slot S on, in slot order."""
    out = shuffle_shards(records, shards, seed, size, **sizes)
    out.select("record", "slot", "shard", "first").sortWithinPartitions("shard", "first", "slot").write.partitionBy("shard", "first").parquet(path)


#: Bytes of a document's other columns and of a row, beside its text.
ROW_BYTES = 64


def op3(spark, sf_dir: str) -> DataFrame:
    """All documents, whole, in shards 0 to 7 under the law ``rows``; size and CRC are of the texts as they left the shuffle. A null text has size 1 and CRC 0."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = shuffle_shards(docs, 8, size=F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES)
    text = F.coalesce("record.text", F.lit(""))
    size, crc = (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    return out.select("record.doc_id", size, crc, F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

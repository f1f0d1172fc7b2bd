"""Rollout groups: statistics, retention, advantages, paging; and set operations on ids."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FLAT = 1e-8


def group_stats(rollouts: DataFrame, by: str, reward: str) -> DataFrame:
    """n, mean, population deviation and variance, whether all are zero, whether all are equal, and retained: resolved and not flat."""
    r = F.col(reward)
    out = rollouts.groupBy(by).agg(F.count("*").alias("n"), F.count(r).alias("n_resolved"), F.avg(r).alias("mean"), F.stddev_pop(r).alias("std"), F.var_pop(r).alias("variance"), (F.count(F.when(r != 0, 1)) == 0).alias("all_zero"), (F.min(r) == F.max(r)).alias("all_equal"))
    return out.withColumn("retained", (F.col("n") == F.col("n_resolved")) & ~F.coalesce("all_equal", F.lit(True)))


def retained(rollouts: DataFrame, by: str, reward: str) -> DataFrame:
    """Rollouts of the groups that are wholly resolved and not flat."""
    kept = group_stats(rollouts, by, reward).where("retained").select(by)
    return rollouts.join(kept, by, "left_semi")


def advantages(rollouts: DataFrame, by: str, reward: str) -> DataFrame:
    """advantage: distance from the group's mean in population deviations; null with fewer than two resolved rewards or a flat group.

    The statistics are aggregated and joined back, so no group is sorted.
    """
    stats = rollouts.groupBy(by).agg(F.avg(reward).alias("_m"), F.stddev_pop(reward).alias("_s"), F.count(reward).alias("_n"))
    out = rollouts.join(stats, by)
    return out.withColumn("advantage", F.when((F.col("_n") >= 2) & (F.col("_s") > FLAT), (F.col(reward) - F.col("_m")) / F.col("_s"))).drop("_m", "_s", "_n")


def tie_broken(rollouts: DataFrame, by: str, reward: str, signal: Column, weight: float = 0.05) -> DataFrame:
    """The older form: a flat group is ranked by a weak signal instead, and a deviation of zero counts as one."""
    stats = rollouts.groupBy(by).agg(F.stddev_pop(reward).alias("_s"))
    mixed = rollouts.join(stats, by).withColumn("_r", F.when(F.col("_s") <= FLAT, F.col(reward) + weight * signal).otherwise(F.col(reward))).drop("_s")
    again = mixed.groupBy(by).agg(F.avg("_r").alias("_m"), F.stddev_pop("_r").alias("_s"))
    return mixed.join(again, by).withColumn("advantage", (F.col("_r") - F.col("_m")) / F.when(F.col("_s") <= FLAT, 1.0).otherwise(F.col("_s"))).drop("_r", "_m", "_s")


def positions(rows: DataFrame, h: Column, order: list[str], each: int = 1 << 16) -> DataFrame:
    """position of each row, from 0, in order of the 64-bit hash h and then of the columns. Rows are ranked within buckets of the hash's range,
    about ``each`` rows a bucket, and the buckets' counts are added up; so no task sees all rows."""
    bits = max(0, math.ceil(math.log2(max(1, rows.count() / each))))
    hashed = rows.withColumn("_h", h)
    # Shifting the sign bit first keeps the order of signed hashes.
    bucket = F.shiftrightunsigned(F.col("_h").bitwiseXOR(F.lit(-(1 << 63))), 64 - bits) if bits else F.lit(0).cast("long")
    hashed = hashed.withColumn("_b", bucket)
    counts = hashed.groupBy("_b").agg(F.count("*").alias("_n")).withColumn("_g", F.shiftright("_b", 10))
    groups = {r["_g"]: r["n"] for r in counts.groupBy("_g").agg(F.sum("_n").alias("n")).collect()}  # one row for each 1024 buckets
    before, offsets = 0, []
    for g in sorted(groups):
        offsets.append((g, before))
        before += groups[g]
    offsets = rows.sparkSession.createDataFrame(offsets, "_g long, _before long")
    first = F.sum("_n").over(W.partitionBy("_g").orderBy("_b")) - F.col("_n") + F.col("_before")
    counts = counts.join(offsets, "_g").select("_b", first.alias("_first"))
    rank = F.row_number().over(W.partitionBy("_b").orderBy("_h", *order)) - 1
    return hashed.withColumn("_r", rank).join(counts, "_b").withColumn("position", F.col("_first") + F.col("_r")).drop("_b", "_h", "_r", "_first")


def epoch_pages(rows: DataFrame, key: str, epoch: int, size: int, seed: int = 0) -> DataFrame:
    """position and page of each row in a permutation of the epoch, by hash: a stream of its own, the same on every cluster."""
    out = positions(rows, F.xxhash64(F.lit(seed), F.lit(epoch), key), [key])
    return out.withColumn("page", F.floor(F.col("position") / size))


def seeded_pages(spark, keys: list, epoch: int, size: int, seed: int = 0) -> DataFrame:
    """key, position, page by Python's generator seeded with seed + epoch: the reproducible order of a small list of scheduled keys."""
    order = list(keys)
    random.Random(seed + epoch).shuffle(order)
    return spark.createDataFrame([(k, i, i // size) for i, k in enumerate(order)], "key string, position int, page int")


def full_roster(roster: DataFrame, metrics: DataFrame, key: str) -> DataFrame:
    """Every scheduled episode with its metrics; those that ended early have zeros, so denominators stay whole."""
    numeric = [c for c, t in metrics.dtypes if c != key and t in ("int", "bigint", "double", "float")]
    return roster.join(metrics, key, "left").na.fill(0, numeric)


def set_compare(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """n_a, n_b, common, only_a, only_b of two sets of ids."""
    a, b = a.select(key).distinct().withColumn("_a", F.lit(1)), b.select(key).distinct().withColumn("_b", F.lit(1))
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    n = lambda c: F.count(F.when(c, 1))
    return a.join(b, key, "full_outer").agg(F.count("_a").alias("n_a"), F.count("_b").alias("n_b"), n(both).alias("common"), n(F.col("_b").isNull()).alias("only_a"), n(F.col("_a").isNull()).alias("only_b"))


def exact_partition(scheduled: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """key and problem (repeated, missing, unexpected): empty if the schedule has every expected id exactly once."""
    counts = scheduled.groupBy(key).agg(F.count("*").alias("n")).join(expected.select(key).distinct().withColumn("_e", F.lit(1)), key, "full_outer")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("_e").isNull(), "unexpected").when(F.col("n") > 1, "repeated")
    return counts.select(key, problem.alias("problem")).where("problem IS NOT NULL")

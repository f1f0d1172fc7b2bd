"""Quality by hierarchical empirical Bayes: what a document shows, and what its path and host lead one to expect.

Document evidence is a sum of log likelihood ratios of six binned measurements, counted on all labelled documents and tempered, as the
measurements are not independent. Site evidence comes from all documents: each counts with its label, or where it has none with the
probability that its own evidence gives. Hosts are shrunk toward the global mean, paths toward their host's posterior mean; how
strongly is estimated from the spread between sites beyond what sampling explains (by moments). Every document, labelled or not, is taken out of
its own site's counts, so its evidence counts once. The score is the posterior probability of good quality: the path's posterior odds times the document's likelihood ratio.

Everything is grouped aggregation with partial sums before the shuffle, so a host with a third of all rows is no hot spot; only sums over
all rows and bins come to the driver.

A null text counts as an empty one. Texts of any length are measured whole. Null hosts and paths are sites of their own. Null labels count as none; a doc_id labelled twice has the higher label. A null doc_id has no label. Without labels of both kinds, no measurement
counts for anything and the mean is one half. Repeated rows count as often as they occur. Extra columns take no part; an empty table
gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import WS, let, materialize

#: Share of the summed log likelihood ratios that counts.
TEMPER = 0.5
#: Pseudo-count of each bin.
SMOOTH = 0.5
KEEP = 0.5
#: Bins of each measurement.
BINS = {"length": 16, "symbols": 11, "distinct": 11, "word_length": 16, "repeated_lines": 11, "ends": 11}


def bins(text: Column) -> Column:
    """A struct of the six measurements' bins."""
    text = F.coalesce(text, F.lit(""))
    bare = F.btrim(text, F.lit(WS))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[ \t-\r]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(WS))) > 0)
    counted = F.struct(
        let(words, lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct"), F.length(F.array_join(w, "")).alias("chars"))).alias("w"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("distinct"), F.size(F.filter(x, lambda s: F.substring(F.rtrim(s), -1, 1).isin(".", "!", "?"))).alias("ends"))).alias("l"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).alias("symbols"),
    )

    def binned(c: Column) -> Column:
        n, lines_n = F.greatest(c["w"]["n"], F.lit(1)), F.greatest(c["l"]["n"], F.lit(1))
        tenths = lambda x, of: F.least(F.floor(10 * x / of), F.lit(10)).cast("int")
        return F.struct(
            sum((F.when(c["w"]["n"] >= 2**k, 1).otherwise(0) for k in range(15)), F.lit(0)).alias("length"),
            tenths(c["symbols"], n).alias("symbols"),
            tenths(c["w"]["distinct"], n).alias("distinct"),
            F.least(F.floor(c["w"]["chars"] / n), F.lit(15)).cast("int").alias("word_length"),
            tenths(c["l"]["n"] - c["l"]["distinct"], lines_n).alias("repeated_lines"),
            tenths(c["l"]["ends"], lines_n).alias("ends"),
        )

    return let(counted, binned)


def _logit(p: Column) -> Column:
    return F.ln(p / (1 - p))


def _strength(sites: DataFrame) -> float:
    """Pseudo-documents of the parent's mean: from columns n, s and parent mean m of each site, by moments."""
    w = F.col("n") * F.pow(F.col("s") / F.col("n") - F.col("m"), 2)
    row = sites.where("n > 0").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(w).alias("between"), F.sum(F.col("m") * (1 - F.col("m"))).alias("within")).first()
    if not row["n"]:
        return 1.0
    mean_within = row["within"] / row["k"]
    beyond = row["between"] / row["n"] - mean_within * row["k"] / row["n"]
    return min(1e6, max(1.0, mean_within / beyond - 1)) if beyond > 0 else 1e6


def classify(docs: DataFrame, labels: DataFrame, host: str, path: str, text: str = "text") -> DataFrame:
    """doc_id, host, path, evidence, host_mean, path_mean, score and kept of every document. labels: doc_id, quality (above 0 is good)."""
    given = docs.select(F.col("doc_id"), F.col(f"`{host}`").cast("string").alias("host"), F.col(f"`{path}`").cast("string").alias("path"), bins(F.col(f"`{text}`")).alias("b"))
    given = materialize(given.select("doc_id", "host", "path", "b.*"), "measured")
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg((F.max("quality") > 0).cast("int").alias("good"))
    rows = given.join(known, "doc_id", "left")

    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(c).alias("bin")) for i, c in enumerate(BINS)])).alias("x")
    seen = {(r["f"], r["bin"], r["good"]): r["n"] for r in rows.where("good IS NOT NULL").select("good", pairs).groupBy("x.f", "x.bin", "good").agg(F.count("*").alias("n")).collect()}
    totals = [sum(n for (f, _, g), n in seen.items() if f == 0 and g == k) for k in (0, 1)]
    both = all(totals)

    def ratio(f: int, b: int, size: int) -> float:
        of = [(seen.get((f, b, k), 0) + SMOOTH) / (totals[k] + SMOOTH * size) for k in (0, 1)]
        return math.log(of[1] / of[0])

    tables = [F.array(*[F.lit(ratio(i, b, size)) for b in range(size)]) for i, size in enumerate(BINS.values())]
    evidence = TEMPER * sum((F.element_at(t, F.col(c) + 1) for t, c in zip(tables, BINS, strict=True)), F.lit(0.0)) if both else F.lit(0.0)
    base = math.log(totals[1] / totals[0]) if both else 0.0
    own = 1 / (1 + F.exp(-(F.col("evidence") + base)))
    rows = rows.select("doc_id", "host", "path", "good", evidence.alias("evidence")).withColumn("y", F.coalesce(F.col("good").cast("double"), own))
    rows = materialize(rows, "evidence")

    paths = rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("y").alias("s"))
    paths = materialize(paths, "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = min(1 - 1e-6, max(1e-6, total["s"] / total["n"])) if total["n"] else 0.5
    k_host = _strength(hosts.withColumn("m", F.lit(mean)))
    hosts = hosts.select(F.col("host").alias("h"), F.col("n").alias("host_n"), F.col("s").alias("host_s"))
    sites = paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    k_path = _strength(sites.withColumn("m", (F.col("host_s") + k_host * mean) / (F.col("host_n") + k_host)))

    # What a document itself gave to its site's counts is taken out again.
    sites = sites.withColumnsRenamed({"host": "h", "path": "p"})
    joined = rows.join(sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")))
    out_n, out_s = F.lit(1), F.col("y")
    joined = joined.withColumn("host_mean", (F.col("host_s") - out_s + k_host * mean) / (F.col("host_n") - out_n + k_host))
    joined = joined.withColumn("path_mean", (F.col("s") - out_s + k_path * F.col("host_mean")) / (F.col("n") - out_n + k_path))
    expected = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("path_mean")))
    score = 1 / (1 + F.exp(-(F.col("evidence") + _logit(expected))))
    return joined.select("doc_id", "host", "path", "evidence", "host_mean", "path_mean", score.alias("score"), (score >= KEEP).alias("kept"))


def op4(spark, sf_dir: str) -> DataFrame:
    """Posterior quality of all documents; the source is the host, and source and language together are the path."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.withColumn("_path", F.concat_ws("/", "source", "lang"))
    out = classify(docs, labels, "source", "_path")
    return out.select("doc_id", "host", "path", *[F.round(c, 4).alias(c) for c in ("evidence", "host_mean", "path_mean", "score")], "kept")

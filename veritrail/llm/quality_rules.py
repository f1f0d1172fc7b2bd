"""Quality rules as a bitmask ledger, in DataFrame operations only.

Every rule is evaluated once per document; the ledger keeps its measurements and one failure bit per rule. A policy is a named version
with a mask of rules: what it keeps, and what each rule adds to it, follow from the stored bits alone by bitwise operations, without
reading a text again.

A null text counts as a text without words; texts of any length are measured whole. Empty and blank texts fail ``few_words``. Each row is measured by itself, so repeated rows
get equal rows. Extra columns pass through ``ledger`` unchanged, in one struct; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import WS, let

#: Names of the rules in the order of their bits.
NAMES = ("few_words", "repeated_words", "symbols", "repeated_lines", "short_words", "long_words")
#: version: rules that reject.
POLICIES = {"1": ("few_words", "repeated_words"), "2": NAMES}
CURRENT = "2"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that the text has twice or more. Windows compare by a 64-bit hash of their words."""
    n = F.size(words) - 2
    hashes = F.zip_with(F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.xxhash64(a, b)), F.slice(words, 3, n), lambda x, c: F.xxhash64(x, c))

    def among(h: Column) -> Column:
        at = F.sort_array(F.zip_with(h, F.sequence(F.lit(0), F.size(h) - 1), lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        pairs = lambda s: F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
        twice = F.array_distinct(F.flatten(F.filter(let(at, pairs), lambda p: p.isNotNull())))
        inside = F.array_distinct(F.flatten(F.transform(twice, lambda i: F.array(i, i + 1, i + 2))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), F.size(inside)).otherwise(0)

    return F.when(n > 1, let(hashes, among)).otherwise(0)


def measures(text: Column) -> Column:
    """A struct of MEASURES for a text."""
    text = F.coalesce(text, F.lit(""))
    bare = F.btrim(text, F.lit(WS))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[ \t-\r]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(WS))) > 0)
    of_words = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeat_words(w).cast("long").alias("n_repeat_words")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return F.struct(of_words.alias("w"), of_lines.alias("l"), F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"))


def _failures(m: dict[str, Column]) -> dict[str, Column]:
    """Whether each rule fails, from the measurements."""
    return {
        "few_words": m["n_words"] < 50,
        "repeated_words": 100 * m["n_repeat_words"] > 50 * m["n_words"],
        "symbols": 10 * m["n_symbols"] > m["n_words"],
        "repeated_lines": 2 * m["n_dup_lines"] > m["n_lines"],
        "short_words": m["word_chars"] < 2 * m["n_words"],
        "long_words": m["word_chars"] > 20 * m["n_words"],
    }


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """record (a struct of all input columns), the measurements, and fail_bits: bit i is set where rule NAMES[i] fails."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    m = docs.select(whole.alias("record"), measures(F.col(f"`{text}`")).alias("m"))
    m = m.select("record", *[F.col(f"m.{'l' if n in ('n_dup_lines', 'n_lines') else 'w'}.{n}" if n != "n_symbols" else "m.n_symbols").alias(n) for n in MEASURES])
    failed = _failures({n: F.col(n) for n in MEASURES})
    bits = sum((F.when(failed[n], 1 << i).otherwise(0) for i, n in enumerate(NAMES)), F.lit(0))
    return m.withColumn("fail_bits", bits.cast("long"))


def mask(version: str) -> int:
    return sum(1 << NAMES.index(n) for n in POLICIES[version])


def keeps(version: str = CURRENT, bits: str = "fail_bits") -> Column:
    """Whether the policy of that version keeps a row of the ledger."""
    return F.col(bits).bitwiseAND(F.lit(mask(version))) == 0


def ablations(rows: DataFrame, versions: tuple[str, ...] = tuple(POLICIES)) -> DataFrame:
    """Per policy and rule of it: rows rejected by the policy, rows that the rule fails, and rows that only it rejects.

    One aggregation over the distinct masks; the texts are not read.
    """
    seen = rows.groupBy("fail_bits").agg(F.count("*").alias("n"))
    rules = [F.struct(F.lit(v).alias("version"), F.lit(mask(v)).alias("mask"), F.lit(n).alias("rule"), F.lit(1 << NAMES.index(n)).alias("bit")) for v in versions for n in POLICIES[v]]
    each = seen.select("fail_bits", "n", F.explode(F.array(*rules)).alias("r")).select("n", "r.*", F.col("fail_bits").bitwiseAND(F.col("r.mask")).alias("hit"))
    count = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))
    return each.groupBy("version", "rule").agg(count(F.col("hit") != 0).alias("rejected"), count(F.col("hit").bitwiseAND(F.col("bit")) != 0).alias("failed"), count(F.col("hit") == F.col("bit")).alias("only"))


def op7(spark, sf_dir: str) -> DataFrame:
    """The ledger of all documents with the verdict of the current policy."""
    out = ledger(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    base = F.col("fail_bits").bitwiseAND(F.lit(mask("1"))) != 0
    return out.select("record.doc_id", *MEASURES, "fail_bits", F.lit(CURRENT).alias("policy"), base.alias("base_failed"), (~base & keeps()).alias("kept"))


def rule_ablations(spark, sf_dir: str) -> DataFrame:
    """What each rule adds to each policy, over the ledger of all documents."""
    return ablations(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text")))

"""Joins of citations, supports and receipts, of calls and observations, of targets and questions; each keeps what does not match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STRONG_TOOLS = ("read", "read_table", "grep_document")


def with_target(questions: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """Every question with its target; target_missing marks those without one."""
    marked = targets.withColumn("_there", F.lit(True))
    return questions.join(marked, key, "left").withColumn("target_missing", F.col("_there").isNull()).drop("_there")


def paired(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both sides by key, with pair_status both, left_only or right_only: the check that id sets are equal is that all are both."""
    a, b = a.withColumn("_a", F.lit(True)), b.withColumn("_b", F.lit(True))
    status = F.when(F.col("_b").isNull(), "left_only").when(F.col("_a").isNull(), "right_only").otherwise("both")
    return a.join(b, keys, "full_outer").withColumn("pair_status", status).drop("_a", "_b")


def guarded(primary: DataFrame, secondary: DataFrame, key: str, guard: str) -> DataFrame:
    """Primary rows with the secondary's; guard_ok is false where the guard columns differ, null where there is no secondary."""
    other = secondary.withColumnRenamed(guard, "_guard").withColumn("_there", F.lit(True))
    return primary.join(other, key, "left").withColumn("guard_ok", F.when(F.col("_there"), F.col(guard).eqNullSafe(F.col("_guard")))).drop("_guard", "_there")


def call_pairs(calls: DataFrame, observations: DataFrame, keys: list[str]) -> DataFrame:
    """keys, calls, observations, pairing: paired, unanswered, orphan or repeated."""
    c = calls.groupBy(*keys).agg(F.count("*").alias("calls"))
    o = observations.groupBy(*keys).agg(F.count("*").alias("observations"))
    out = c.join(o, keys, "full_outer").na.fill(0, ["calls", "observations"])
    pairing = F.when((F.col("calls") > 1) | (F.col("observations") > 1), "repeated").when(F.col("observations") == 0, "unanswered").when(F.col("calls") == 0, "orphan").otherwise("paired")
    return out.withColumn("pairing", pairing)


def cited(citations: DataFrame, receipts: DataFrame, episode: str = "episode_id") -> DataFrame:
    """Citations with valid: there is such a receipt, with that document and page, delivered before the turn, and with text; and with its tool."""
    known = receipts.select(episode, "receipt_id", "document_id", "page", F.col("tool").alias("receipt_tool"), F.col("text").alias("receipt_text"), "delivered_turn")
    out = citations.join(known, [episode, "receipt_id", "document_id", "page"], "left")
    shown = F.coalesce(F.length("receipt_text") > 0, F.lit(False))
    in_time = F.coalesce(F.col("delivered_turn") < F.col("turn"), F.lit(False)) if "turn" in citations.columns else F.lit(True)
    return out.withColumn("valid", shown & in_time).withColumn("strong", F.col("valid") & F.coalesce(F.col("receipt_tool").isin(*STRONG_TOOLS), F.lit(False)))


def contained(spans: DataFrame, pages: DataFrame, keys: list[str], quote: str = "quote", text: str = "text", normalize: bool = False) -> DataFrame:
    """Spans with offset of their quote in the page of the same keys (from 0) and found; normalize compares with single blanks."""
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " ")) if normalize else c
    at = F.instr(flat(F.col("_text")), flat(F.col(quote)))
    out = spans.join(pages.select(*keys, F.col(text).alias("_text")), keys, "left")
    hit = F.coalesce((F.length(quote) > 0) & (at > 0), F.lit(False))
    return out.withColumn("found", hit).withColumn("offset", F.when(hit, at - 1)).drop("_text")


def shortest_quote(found: DataFrame, by: list[str], quote: str = "quote") -> DataFrame:
    """The shortest quote found for each claim, ties by text."""
    ok = found.where("found")
    return ok.groupBy(*by).agg(F.min(F.struct(F.length(quote), F.col(quote))).alias("m")).select(*by, F.col(f"m.{quote}").alias(quote))


def all_claims_covered(claims: DataFrame, covered: DataFrame, by: str, claim: str = "claim") -> DataFrame:
    """Relational division: by, claims, covered, all_covered. covered: (by, claim) of the claims that some visible receipt supports."""
    c = claims.select(by, claim).distinct().join(covered.select(by, claim).distinct().withColumn("_c", F.lit(1)), [by, claim], "left")
    out = c.groupBy(by).agg(F.count("*").alias("claims"), F.count("_c").alias("covered"))
    return out.withColumn("all_covered", F.col("claims") == F.col("covered"))


def same_sets(a: DataFrame, b: DataFrame, by: str, item: str) -> DataFrame:
    """by, missing (in a only), invented (in b only), equal: exact equality of two sets of ids per group."""
    pair = paired(a.select(by, item).distinct(), b.select(by, item).distinct(), [by, item])
    count = lambda s: F.count(F.when(F.col("pair_status") == s, 1))
    out = pair.groupBy(by).agg(count("left_only").alias("missing"), count("right_only").alias("invented"))
    return out.withColumn("equal", (F.col("missing") == 0) & (F.col("invented") == 0))


def is_subset(items: Column, of: Column) -> Column:
    """Whether an array's elements are all in another; an empty one is no support."""
    return (F.size(items) > 0) & (F.size(F.array_except(items, of)) == 0)


def page_hits(gold: DataFrame, reads: DataFrame, by: str) -> DataFrame:
    """by, gold_page_read: whether some gold (document_id, page) was read."""
    hit = gold.join(reads.select(by, "document_id", "page").distinct().withColumn("_r", F.lit(1)), [by, "document_id", "page"], "left")
    return hit.groupBy(by).agg((F.count("_r") > 0).alias("gold_page_read"))


def cached(requests: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Requests with the cached verdict of the same content key; cache_hit tells which have one."""
    return requests.join(cache.dropDuplicates([key]).withColumn("_hit", F.lit(True)), key, "left").withColumn("cache_hit", F.coalesce("_hit", F.lit(False))).drop("_hit")


def same_order(a: DataFrame, b: DataFrame, key: str, position: str) -> DataFrame:
    """Positions at which two ordered tables have different keys, or only one has a row: empty if their key sequences are equal."""
    pair = paired(a.select(position, F.col(key).alias("a_key")), b.select(position, F.col(key).alias("b_key")), [position])
    return pair.where((F.col("pair_status") != "both") | ~F.col("a_key").eqNullSafe(F.col("b_key")))


def receipts(deliveries: DataFrame, episode: str, order: list[str]) -> DataFrame:
    """Deliveries numbered r1, r2, ... within their episode, in order."""
    n = F.row_number().over(W.partitionBy(episode).orderBy(*order))
    return deliveries.withColumn("receipt_id", F.concat(F.lit("r"), n.cast("string")))


def support_reads(supports: DataFrame, pages: DataFrame, by: str, limit: int = 2400) -> DataFrame:
    """by, document_id, page, start, end of the reads that show each support's quote exactly, each once; none for a target with a quote that cannot be shown.

    supports: by, document_id, page, quote; pages: document_id, page, text.
    """
    found = contained(supports, pages, ["document_id", "page"]).withColumn("end", F.col("offset") + F.length("quote"))
    usable = F.coalesce(F.col("found") & (F.length("quote") <= limit), F.lit(False))
    whole = found.groupBy(by).agg(F.bool_and(usable).alias("_all")).where("_all").select(by)
    return found.join(whole, by, "left_semi").select(by, "document_id", "page", F.col("offset").alias("start"), "end").distinct()


def claim_citations(supports: DataFrame, receipts: DataFrame, by: str, order: str) -> DataFrame:
    """by and receipt_ids: for each claim the first strong receipt that has one of its quotes, each once, in order; only where all claims have one.

    supports: by, claim, document_id, page, quote; receipts: by, receipt_id, tool, document_id, page, text and the order column.
    """
    strong = receipts.where(F.col("tool").isin(*STRONG_TOOLS)).select(by, "receipt_id", "document_id", "page", "text", order)
    hits = supports.join(strong, [by, "document_id", "page"]).where((F.length("quote") > 0) & F.col("text").contains(F.col("quote")))
    first = hits.groupBy(by, "claim").agg(F.min(F.struct(order, "receipt_id")).alias("m"))
    whole = all_claims_covered(supports, first.select(by, "claim"), by).where("all_covered").select(by)
    chosen = first.join(whole, by, "left_semi").select(by, "m").distinct()
    return chosen.groupBy(by).agg(F.transform(F.sort_array(F.collect_list("m")), lambda m: m["receipt_id"]).alias("receipt_ids"))


def named_observations(calls: DataFrame, observations: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Observations without call ids with the name of the call they answer: the k-th observation of a trace answers its k-th call. name is null past the calls."""
    n = F.row_number().over(W.partitionBy(by).orderBy(*order))
    c = calls.withColumn("_k", n).select(by, "_k", "name")
    return observations.withColumn("_k", n).join(c, [by, "_k"], "left").drop("_k")

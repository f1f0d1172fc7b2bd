"""Selection of recorded traces: eligibility, classification with reasons, dedupe with lineage, one row per key, audits and checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import numbers as N

UNAVAILABLE = ("not available", "n/a", "none", "na", "null")


def call_facts(calls: DataFrame, by: str, position: str, name: str = "name") -> DataFrame:
    """by, n_calls, n_finish, last_call, n_calculate, n_parse_errors of each trace. calls may have parse_error."""
    errors = F.sum(F.coalesce(F.col("parse_error").cast("int"), F.lit(0))) if "parse_error" in calls.columns else F.lit(0)
    count = lambda tool: F.sum((F.col(name) == tool).cast("int"))
    return calls.groupBy(by).agg(F.count("*").alias("n_calls"), count("finish").alias("n_finish"), F.max_by(name, position).alias("last_call"), count("calculate").alias("n_calculate"), errors.alias("n_parse_errors"))


def eligible(termination: Column, f: Column, a: Column, g: Column, unresolved: Column, error_observations: Column) -> Column:
    """Over call_facts: ended by one finish as its last call, all components 1, resolved, no parse error, no calculator, no error observed."""
    whole = (termination == "finish") & (f == 1) & (a == 1) & (g == 1) & ~F.coalesce(unresolved, F.lit(False))
    calls = (F.col("n_finish") == 1) & (F.col("last_call") == "finish") & (F.col("n_parse_errors") == 0) & (F.col("n_calculate") == 0)
    return F.coalesce(whole & calls & (error_observations == 0), F.lit(False))


def identified_teacher(model: Column) -> Column:
    m = F.lower(F.trim(F.coalesce(model, F.lit(""))))
    return ~m.isin("", "unknown") & ~m.startswith("gold_recovery")


def model_names(frame: DataFrame, aliases: DataFrame, model: str = "model") -> DataFrame:
    """The model column by a small table of (alias, name); unknown names stay."""
    known = aliases.select(F.col("alias").alias(model), F.col("name").alias("_name"))
    return frame.join(known, model, "left").withColumn(model, F.coalesce("_name", model)).drop("_name")


def filter_reason(gold: Column, answer: Column) -> Column:
    """The first reason against an answer: empty, unavailable, numeric_mismatch, sign_conflict; null if there is none."""
    numeric = F.size(N.plain_numbers(gold)) > 0
    return (
        F.when(answer == "", "empty")
        .when(F.lower(answer).isin(*UNAVAILABLE), "unavailable")
        .when(numeric & ~N.close_numbers(gold, answer), "numeric_mismatch")
        .when(numeric & N.sign_conflict(gold, answer), "sign_conflict")
    )


def filtered(frame: DataFrame, gold: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(kept with clean_answer, dropped with filter_reason)."""
    out = frame.withColumn("clean_answer", A.last_line_answer(F.col(text)))
    out = out.withColumn("filter_reason", filter_reason(F.col(gold), F.col("clean_answer")))
    return out.where("filter_reason IS NULL").drop("filter_reason"), out.where("filter_reason IS NOT NULL").drop("clean_answer")


def reasons(**conditions: Column) -> Column:
    """The names of the conditions that hold, sorted."""
    return F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in conditions.items()])))


def status(found: Column) -> Column:
    return F.when(F.size(found) > 0, "quarantined").otherwise("candidate")


def first_per(frame: DataFrame, by: list[str], order: list[str | Column]) -> DataFrame:
    """One row per key, the first in order. The order should end in a column that breaks ties."""
    return frame.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def with_duplicates(frame: DataFrame, identity: str, order: list[str], source: Column) -> DataFrame:
    """duplicate_of: the source of the first row of the same identity; null for that row itself."""
    w = W.partitionBy(identity).orderBy(*order)
    return frame.withColumns({"_n": F.row_number().over(w), "_first": F.first(source).over(w)}).withColumn("duplicate_of", F.when(F.col("_n") > 1, F.col("_first"))).drop("_n", "_first")


def judged_pass(verdict: Column, correctness: Column, grounding: Column) -> Column:
    return F.coalesce((verdict == "pass") & (correctness >= 3) & (grounding >= 1), F.lit(False))


def provider_failure(reason: Column, unresolved: Column) -> Column:
    return F.coalesce(unresolved & F.split(reason, ":")[0].isin("HTTPError", "TimeoutError", "URLError"), F.lit(False))


def rate_limited(message: Column) -> Column:
    return F.coalesce(F.lower(message).rlike(r"429|rate.?limit|too many requests"), F.lit(False))


def length_safe(frame: DataFrame, tokens: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """Whole rows within the limit, and those beyond it; nothing is truncated."""
    return frame.where(F.col(tokens) <= limit), frame.where(F.coalesce(F.col(tokens) > limit, F.lit(True)))


def violations(frame: DataFrame, keys: list[str], **rules: Column) -> DataFrame:
    """keys and the names of the rules that a row breaks; rows that break none are left out. A rule that is null is broken."""
    broken = reasons(**{n: ~F.coalesce(c, F.lit(False)) for n, c in rules.items()})
    return frame.select(*keys, broken.alias("violations")).where(F.size("violations") > 0)


def evaluation_violations(rows: DataFrame, expected: DataFrame, stop_reasons: tuple[str, ...]) -> DataFrame:
    """run_id, question_id, violation: bad values, implications, repeated rows, missing and extra questions, more than one signature."""
    c = F.col
    unit = [F.coalesce((c(k) >= 0) & (c(k) <= 1), c("unresolved") & c(k).isNull()) for k in ("F", "A", "G", "correct", "grounded_success")]
    single = violations(
        rows, ["run_id", "question_id"],
        component_range=reduce(lambda a, b: a & b, unit),
        stop_reason=c("stop_reason").isin(*stop_reasons),
        correct_needs_finish=~((c("correct") == 1) & (c("F") == 0)),
        grounded_needs_correct=~((c("grounded_success") == 1) & (c("correct") == 0)),
    ).select("run_id", "question_id", F.explode("violations").alias("violation"))
    repeated = rows.groupBy("run_id", "sampling_seed", "question_id").count().where("count > 1").select("run_id", "question_id", F.lit("repeated").alias("violation"))
    runs = rows.select("run_id", "sampling_seed").distinct()
    wanted = runs.crossJoin(F.broadcast(expected.select("question_id").distinct()))  # runs and questions of a frozen protocol
    have = rows.select("run_id", "sampling_seed", "question_id").distinct()
    keys = ["run_id", "sampling_seed", "question_id"]
    missing = wanted.join(have, keys, "left_anti").select("run_id", "question_id", F.lit("missing").alias("violation"))
    extra = have.join(wanted, keys, "left_anti").select("run_id", "question_id", F.lit("extra").alias("violation"))
    signatures = rows.agg(F.count_distinct("evaluation_signature").alias("n")).where("n > 1").select(F.lit(None).cast("string").alias("run_id"), F.lit(None).cast("string").alias("question_id"), F.lit("signatures").alias("violation"))
    return reduce(DataFrame.unionByName, [single, repeated, missing, extra, signatures])


def audit_sample(frame: DataFrame, key: str, fixed: Column, buckets: list[Column], order: list[str], cap: int) -> DataFrame:
    """Fixed rows first, then one row of each other key by the first bucket that holds, in order, up to the cap. bucket: 0 for fixed, then 1, 2, ..."""
    bucket = reduce(lambda acc, b: acc.when(b[1], b[0]), enumerate(buckets, 1), F.when(fixed, 0))
    some = frame.withColumn("bucket", bucket).where("bucket IS NOT NULL")
    first = F.row_number().over(W.partitionBy(key).orderBy("bucket", *order))
    return some.withColumn("_n", first).where("bucket = 0 OR _n = 1").drop("_n").orderBy("bucket", *order).limit(cap)


def selection_summary(selected: DataFrame, question: str, model: str) -> DataFrame:
    """rows, questions, least and most rows of a question, and rows by model as a map."""
    per = selected.groupBy(question).agg(F.count("*").alias("n")).agg(F.sum("n").alias("selected_rows"), F.count("*").alias("unique_questions"), F.coalesce(F.min("n"), F.lit(0)).alias("least"), F.coalesce(F.max("n"), F.lit(0)).alias("most"))
    models = selected.groupBy(model).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(model, "n")))).alias("by_model"))
    return per.crossJoin(models)  # one row each


def disjoint_split(documents: DataFrame, key: str, order: Column, size: str, wanted: int) -> DataFrame:
    """key and split: documents in the given order go to dev until it has the wanted number of rows; no document is in both, and train is never empty.

    documents: one row per document with its number of rows, at least one. Only the first ``wanted`` documents in order can be in dev, so the
    running sum is over these alone; all others are train without being sorted.
    """
    total = documents.agg(F.sum(size)).first()[0] or 0
    head = documents.select(key, F.col(size).alias("_size"), order.alias("_order")).orderBy("_order", key).limit(wanted)
    before = F.coalesce(F.sum("_size").over(W.orderBy("_order", key).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    dev = head.withColumn("_before", before).where((F.col("_before") < wanted) & (F.col("_size") < total - F.col("_before"))).select(key, F.lit("dev").alias("split"))
    return documents.join(dev, key, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def repaired(traces: DataFrame, events: str, inserted: str) -> DataFrame:
    """Event arrays with the inserted events just before the first finish event; unchanged where there is no finish."""
    position = F.array_position(F.transform(events, lambda e: e["name"]), "finish").cast("int")
    edited = F.concat(F.slice(events, 1, position - 1), F.col(inserted), F.slice(events, position, F.size(events)))
    return traces.withColumn(events, F.when(position > 0, edited).otherwise(F.col(events)))


def repair_status(parse_errors: Column, finishes: Column, all_supported: Column, f: Column, a: Column, g: Column) -> Column:
    """accepted, or the first reason to reject a repaired trace."""
    return F.when(parse_errors > 0, "parse_error").when(finishes != 1, "finish_count").when(~all_supported, "unreadable_support").when((f == 1) & (a == 1) & (g == 1), "accepted").otherwise("score")

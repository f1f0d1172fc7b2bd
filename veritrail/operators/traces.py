"""Recorded traces: tool metrics, repeats, guardrails, phases, last submissions, observation budgets, chat forms."""

from __future__ import annotations

import json
from bisect import bisect_right
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from ..functions.calls import call_signature

# Tools by phase, and words of a question that call for a calculation.
PHASES = {"retrieval": ("bm25_search", "search_tables", "grep_document"), "evidence": ("read", "read_table", "grep_document"), "calculation": ("calculate",), "conclusion": ("finish",)}
CALCULATION = r"(?i)(calculate|difference|percent|percentage|ratio|growth|increase|decrease|margin|average|per share)"
OBSERVATION_CAP = 4000
EVIDENCE_PIECE, EVIDENCE_CAP = 1800, 12000
STOP_REASONS = ("accepted_finish", "plain_text", "parse", "validation", "length", "context", "turn_limit", "infrastructure", "other")


def phases(tools: Column) -> Column:
    """The phases that some of the tool names belong to."""
    some = [F.when(F.arrays_overlap(tools, F.array(*map(F.lit, names))), F.array(F.lit(phase))).otherwise(F.array().cast("array<string>")) for phase, names in PHASES.items()]
    return F.flatten(F.array(*some))


def phase_agreement(student: Column, teacher: Column) -> Column:
    """The share of the teacher's phases that the student's tools reach; 0 where either has none."""
    s, t = phases(student), phases(teacher)
    return F.when((F.size(s) > 0) & (F.size(t) > 0), F.size(F.array_intersect(s, t)) / F.greatest(F.size(t), F.lit(1))).otherwise(0.0)


def repeated_calls(calls: DataFrame, by: str, order: list[str], name: str = "name", arguments: str = "arguments") -> DataFrame:
    """Calls with their normalized signature and repeated: an equal one came earlier in the trace."""
    signed = calls.withColumn("signature", call_signature(F.col(name), F.col(arguments)))
    earlier = F.row_number().over(W.partitionBy(by, "signature").orderBy(*order)) > 1
    return signed.withColumn("repeated", earlier)


def guardrails(calls: DataFrame, by: str, order: list[str], name: str = "name") -> DataFrame:
    """Calls (as from repeated_calls) with guardrail: repeat, myopic (a third search in a row) or null."""
    w = W.partitionBy(by).orderBy(*order)
    is_search = lambda c: F.coalesce(c.isin(*PHASES["retrieval"]), F.lit(False))
    row = is_search(F.col(name)) & is_search(F.lag(name, 1).over(w)) & is_search(F.lag(name, 2).over(w))
    return calls.withColumn("guardrail", F.when(F.col("repeated"), "repeat").when(row, "myopic"))


def tool_metrics(calls: DataFrame, observations: DataFrame, by: str, name: str = "name") -> DataFrame:
    """by, total_calls, by_tool (map), repeats, errors, chars. calls need repeated; observations text."""
    per = calls.groupBy(by, name).agg(F.count("*").alias("n"), F.sum(F.col("repeated").cast("long")).alias("r"))
    c = per.groupBy(by).agg(F.sum("n").alias("total_calls"), F.map_from_entries(F.sort_array(F.collect_list(F.struct(name, "n")))).alias("by_tool"), F.sum("r").alias("repeats"))
    error = F.coalesce(F.get_json_object("text", "$.error"), F.lit("")) != ""
    o = observations.groupBy(by).agg(F.sum(error.cast("long")).alias("errors"), F.sum(F.length("text")).alias("chars"))
    return c.join(o, by, "full_outer").na.fill(0, ["total_calls", "repeats", "errors", "chars"])


def process_components(calls: DataFrame, by: str, questions: DataFrame, name: str = "name") -> DataFrame:
    """What process_quality needs, per trace: calls with repeated and guardrail; questions with question and answer."""
    used = lambda tools: F.max(F.coalesce(F.col(name).isin(*tools), F.lit(False)).cast("double"))
    agg = calls.groupBy(by).agg(used(PHASES["retrieval"]).alias("retrieval_used"), used(PHASES["evidence"]).alias("evidence_acquired"), used(PHASES["calculation"]).alias("calculator_used"), F.sum(F.col("repeated").cast("long")).alias("repeated_calls"), F.count("guardrail").alias("guardrail_count"))
    out = questions.join(agg, by, "left").na.fill(0, agg.columns[1:])
    out = out.withColumn("pivoted", F.col("retrieval_used") * F.col("evidence_acquired"))
    out = out.withColumn("arithmetic_compliance", F.when(F.col("question").rlike(CALCULATION), F.col("calculator_used")).otherwise(1.0))
    return out.withColumn("premature_answer", ((F.trim("answer") != "") & (F.col("evidence_acquired") == 0) & (F.col("calculator_used") == 0)).cast("double"))


def last_submission(calls: DataFrame, by: str, position: str, name: str = "name", arguments: str = "arguments") -> DataFrame:
    """by and the arguments of the last finish call of each trace."""
    finishes = calls.where(F.col(name) == "finish")
    return finishes.groupBy(by).agg(F.max_by(arguments, position).alias("submission"), F.count("*").alias("finishes"))


# What an engine's stop reasons are called in reports.
STOPS = {"completed": "plain_text", "parse_error": "parse", "max_tokens": "length", "max_sampled_tokens": "length", "context_overflow": "context", "max_turns": "turn_limit"}


def _stops(stop: Column, leave_out: tuple[str, ...] = ()) -> Column:
    return reduce(lambda c, kv: c.when(stop == kv[0], kv[1]), [kv for kv in STOPS.items() if kv[0] not in leave_out], F.when(F.lit(False), "")).otherwise("other")


def terminal_reason(stop: Column, accepted: Column, validation_errors: Column) -> Column:
    """accepted_finish, validation (errors before an ordinary end), or what the stop is called."""
    ordinary = stop.isin("completed", "max_turns", "tool_stopped")
    return F.when((stop == "tool_stopped") & accepted, "accepted_finish").when((validation_errors > 0) & ordinary, "validation").otherwise(_stops(stop))


def finish_type(stop: Column, accepted: Column, finishes: Column) -> Column:
    return F.when(accepted, "accepted_finish").when(finishes > 0, "finish_rejected").otherwise(_stops(stop, ("completed",)))


def failure_category(accepted: Column, grounded_success: Column, calculation_errors: Column, errors: Column, unresolved: Column, fabricated: Column, a: Column, g: Column) -> Column:
    """The first failure that applies, in a fixed order."""
    return (
        F.when(accepted & (grounded_success == 1), "correct_grounded_finish")
        .when(calculation_errors > 0, "calculation_input_error")
        .when(errors > 0, "tool_validation_error")
        .when(~accepted, "missing_terminal_finish")
        .when(unresolved, "judge_or_semantic_unresolved")
        .when(fabricated | (g == 0), "unsupported_or_ungrounded_evidence")
        .when(a == 0, "incorrect_answer")
        .otherwise("other")
    )


def failure_totals(rows: DataFrame, question: str = "question_id") -> DataFrame:
    """Per question and over all (question null): trajectories, accepted and grounded finishes, errors; one rollup."""
    n = lambda c: F.sum(c.cast("long"))
    return rows.rollup(question).agg(F.count("*").alias("trajectories"), n(F.col("finish_type") == "accepted_finish").alias("accepted"), n(F.col("grounded_success") == 1).alias("grounded"), F.sum("errors").alias("errors"), F.count_distinct("failure_category").alias("categories"))


def error_counts(observations: DataFrame, by: str, text: str = "text") -> DataFrame:
    """by, errors, calculation_errors, judge_errors of the observations that report one."""
    message = F.lower(F.coalesce(F.get_json_object(text, "$.error"), F.lit("")))
    n = lambda c: F.sum(c.cast("long"))
    some = observations.select(by, message.alias("_m")).where("_m <> ''")
    return some.groupBy(by).agg(F.count("*").alias("errors"), n(F.col("_m").rlike("calculation|operand|expression|calculate")).alias("calculation_errors"), n(F.col("_m").rlike("judge|deepinfra|credential")).alias("judge_errors"))


def running_evidence(observations: DataFrame, by: str, order: list[str], piece: int = EVIDENCE_PIECE, cap: int = EVIDENCE_CAP) -> DataFrame:
    """Observations cut to a piece each and to what is left of the cap in their trace; those past it go."""
    cut = observations.withColumn("_piece", F.left(F.coalesce("text", F.lit("")), F.lit(piece)))
    before = F.sum(F.length("_piece")).over(W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    cut = cut.withColumn("_left", F.greatest(F.lit(0), cap - F.coalesce(before, F.lit(0))))
    return cut.withColumn("evidence", F.left("_piece", F.col("_left").cast("int"))).where(F.length("evidence") > 0).drop("_piece", "_left")


CUT_TEXTS = ("text", "content", "neighbor_context", "error")


def _json(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _kept_elements(lists: dict[str, list], excess: int) -> tuple[dict[str, int], int]:
    """How many elements each list keeps so that so many characters go, the longest list losing its last one each time; and what must go still."""
    sizes = {k: [len(_json(x)) + 1 for x in v] for k, v in lists.items()}  # each with a comma, but for the last one of a list
    room = {k: sum(ns) for k, ns in sizes.items()}
    while excess > 0 and (k := max(room, key=room.get, default=None)) is not None and sizes[k]:
        n = sizes[k].pop()
        room[k] -= n
        excess -= n if sizes[k] else n - 1
    return {k: len(ns) for k, ns in sizes.items()}, excess


def _with_texts(out: dict, level: int) -> dict:
    """Its texts cut to so many characters; a page's offsets follow its text, which its provenance no longer fits."""
    new = {k: v[:level] if k in CUT_TEXTS and isinstance(v, str) else v for k, v in out.items()}
    if "start" in new and isinstance(out.get("text"), str) and len(new["text"]) < len(out["text"]):
        end = new["start"] + len(new["text"])
        new |= {"end": end, "next_start": end, "has_more": end < new.get("total_chars", end + 1)}
        new.pop("provenance", None)
    return new


def trim_observation(payload, cap: int) -> str:
    """JSON of at most cap characters: the ends of the longest lists go first, by the sizes of their elements; then texts are cut to one length,
    the largest that fits. A payload that is too long even so becomes an error."""
    out = dict(payload) if isinstance(payload, dict) else {"content": str(payload)}
    note = {"raw_chars": len(_json(out)), "truncated": False}
    out["observation"] = note
    if len(_json(out)) <= cap:
        return _json(out)
    note["truncated"] = True
    lists = {k: v for k, v in out.items() if isinstance(v, list)}
    keep, excess = _kept_elements(lists, len(_json(out)) - cap)
    out |= {k: v[: keep[k]] for k, v in lists.items()}
    if excess <= 0:
        return _json(out)
    longest = max((len(v) for k, v in out.items() if k in CUT_TEXTS and isinstance(v, str)), default=0)
    fits = bisect_right(range(longest), cap, key=lambda level: len(_json(_with_texts(out, level)))) - 1
    return _json(_with_texts(out, fits)) if fits >= 0 else _json({"error": "Observation metadata exceeds the budget.", "observation": note})


def _trimmed(texts: pa.Array, cap: int) -> pa.Array:
    """Only one text at a time is decoded and parsed, so a batch costs its bytes and what is left of each text."""

    def one(t):
        try:
            return trim_observation(json.loads(t), cap)
        except (TypeError, ValueError):
            return trim_observation(t or "", cap)

    return pa.array((one(t.as_py()) for t in texts), pa.string(), size=len(texts))


def bounded_observation(payload: Column, cap: int = OBSERVATION_CAP) -> Column:
    """trim_observation of a JSON text; a structure of unknown shape has no built-in form."""

    @F.arrow_udf(Ty.StringType())
    def run(texts: pa.Array) -> pa.Array:
        return _trimmed(texts, cap)

    return run(payload)


def evidence_texts(observations: DataFrame, by: str, order: list[str]) -> DataFrame:
    """by, strong and weak: the observations' texts after reads, and after searches. Columns: tool, text."""
    joined = lambda tools: F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.when(F.col("tool").isin(*tools), F.struct(*order, "text")))), lambda x: x["text"]))
    return observations.groupBy(by).agg(joined(("read", "read_table", "grep_document")).alias("strong"), joined(("bm25_search", "search_tables")).alias("weak"))


def chat_messages(turns: DataFrame, by: str, position: str, system: str) -> DataFrame:
    """by and messages: the system text first, then the turns in order."""
    rows = F.sort_array(F.collect_list(F.struct(position, "role", F.col("text").alias("content"))))
    messages = F.transform(rows, lambda r: F.struct(r["role"].alias("role"), r["content"].alias("content")))
    return turns.groupBy(by).agg(messages.alias("messages")).withColumn("messages", F.concat(F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content"))), "messages"))


def context_window(turns: DataFrame, by: str, position: str, size: str, budget: int) -> DataFrame:
    """The last turns of each trace that fit the budget together; the newest stays even if it alone does not."""
    newest = W.partitionBy(by).orderBy(F.desc(position))
    total = F.sum(size).over(newest.rowsBetween(W.unboundedPreceding, 0))
    return turns.withColumns({"_total": total, "_n": F.row_number().over(newest)}).where((F.col("_total") <= budget) | (F.col("_n") == 1)).drop("_total", "_n")


def evicted_pairs(turns: DataFrame, by: str, position: str, size: str, budget: int) -> DataFrame:
    """The turns left when the oldest assistant turns go, each with the tool turn right behind it, until the rest fits; other turns stay.

    The first turn of a trace always stays. Sums over what could go decide it, so nothing is tried step by step.
    """
    w = W.partitionBy(by).orderBy(position)
    head = (F.col("role") == "assistant") & (F.row_number().over(w) > 1)
    x = turns.withColumn("_head", head).withColumn("_lead", F.lag("_head").over(w))
    x = x.withColumn("_goes", F.col("_head") | ((F.col("role") == "tool") & F.coalesce("_lead", F.lit(False))))
    x = x.withColumn("_pair", F.sum(F.when(F.col("_head"), 1).otherwise(0)).over(w))
    pairs = x.groupBy(by, "_pair").agg(F.sum(F.when(F.col("_goes"), F.col(size)).otherwise(0)).alias("_size"))
    freed = F.sum("_size").over(W.partitionBy(by).orderBy("_pair").rowsBetween(W.unboundedPreceding, -1))
    total = turns.groupBy(by).agg(F.sum(size).alias("_total"))
    gone = pairs.withColumn("_freed", F.coalesce(freed, F.lit(0))).join(total, by).where(F.col("_total") - F.col("_freed") > budget).select(by, "_pair", F.lit(True).alias("_gone"))
    out = x.join(gone, [by, "_pair"], "left")
    return out.where(~(F.col("_goes") & F.coalesce("_gone", F.lit(False)))).select(*turns.columns)


def context_status(turns: DataFrame, by: str, size: str, reply: int, limit: int) -> DataFrame:
    """by, size and refused: traces that with the reply to come would exceed the limit are refused whole, never cut."""
    return turns.groupBy(by).agg(F.sum(size).alias(size)).withColumn("refused", F.col(size) + reply > limit)


def error_class(text: Column) -> Column:
    """What kind of error an observation reports, or null."""
    message = F.lower(F.coalesce(F.get_json_object(text, "$.error"), F.lit("")))
    rules = (("unknown", "unknown_reference"), ("argument", "arguments"), ("citation", "citation"), ("budget", "budget"), ("rate", "provider"))
    return reduce(lambda c, r: c.when(message.contains(r[0]), r[1]), rules, F.when(message == "", None)).otherwise("other")

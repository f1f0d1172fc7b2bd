"""Reward formulas over component columns. Each scorer has its own version; unresolved is null, never zero."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

TYPED, COMPONENT, ADDITIVE = "typed-v3", "component-v5", "additive-v6"


def in_unit(c: Column) -> Column:
    return F.coalesce((c >= 0) & (c <= 1) & ~F.isnan(c.cast("double")), F.lit(False))


def blended_answer(mode: Column, n: Column, s: Column) -> Column:
    """A: 0.6 numeric + 0.4 semantic where both apply, else the one that does."""
    return F.when(mode == "mixed", 0.6 * n + 0.4 * s).when(mode == "numeric", n).when(mode == "semantic", s)


def component_score(mode: Column, n: Column, s: Column, g: Column, f: Column) -> Column:
    """(A, reward, correct, grounded_success, unresolved, reason): reward F * A * (0.5 + 0.5 G).

    A missing or invalid component that applies, or one that does not apply and is not null, makes the row unresolved.
    """
    n, s, g = (x.cast("double") for x in (n, s, g))
    applies = F.when(mode == "mixed", in_unit(n) & in_unit(s)).when(mode == "numeric", in_unit(n)).when(mode == "semantic", in_unit(s)).otherwise(False)
    valid = F.coalesce(applies & in_unit(g) & f.isin(0, 1), F.lit(False))
    extra = ((mode == "numeric") & s.isNotNull()) | ((mode == "semantic") & n.isNotNull())
    reason = F.when(~valid, "invalid_or_missing_component").when(extra, "nonapplicable_component_must_be_null")

    def scored(a: Column) -> Column:
        correct = (f == 1) & (a == 1)
        return F.struct(a.alias("A"), (f * a * (0.5 + 0.5 * g)).alias("reward"), correct.cast("int").alias("correct"), (correct & (g == 1)).cast("int").alias("grounded_success"), F.lit(False).alias("unresolved"), F.lit(None).cast("string").alias("reason"), F.lit(COMPONENT).alias("scorer_version"))

    nothing = F.struct(F.lit(None).cast("double").alias("A"), F.lit(None).cast("double").alias("reward"), F.lit(0).alias("correct"), F.lit(0).alias("grounded_success"), F.lit(True).alias("unresolved"), reason.alias("reason"), F.lit(COMPONENT).alias("scorer_version"))
    return F.when(reason.isNotNull(), nothing).otherwise(let(blended_answer(mode, n, s), scored))


def additive_reward(e: Column, g: Column, a: Column, b: Column, f: Column) -> Column:
    """0.15 E + F (0.20 G + 0.45 A + 0.15 B + 0.05); null for components out of range, or a bonus without a correct answer."""
    valid = reduce(lambda x, y: x & y, [in_unit(c) for c in (e, g, a, b, f)]) & b.isin(0, 1) & f.isin(0, 1) & ((b == 0) | (a == 1))
    return F.when(F.coalesce(valid, F.lit(False)), 0.15 * e + f * (0.20 * g + 0.45 * a + 0.15 * b + 0.05))


def coverage_value(coverage: Column, known_receipts: Column) -> Column:
    """E: 0, 0.5 or 1 for none, partial or full coverage; 0 without known receipts; null for anything else."""
    value = F.when(coverage == "none", 0.0).when(coverage == "partial", 0.5).when(coverage == "full", 1.0)
    return F.when(value.isNotNull(), F.when(known_receipts, value).otherwise(0.0))


def completeness_bonus(all_claims: Column, answer: Column, contradicted: Column) -> Column:
    return F.coalesce(all_claims & (answer == 1) & ~contradicted, F.lit(False)).cast("int")


def claim_fraction(verdicts: DataFrame, by: str, kind: str, correct: str) -> DataFrame:
    """by and the share of correct verdicts of each kind as N (numeric) and S (semantic); null where there is none."""
    share = lambda k: F.avg(F.when(F.col(kind) == k, F.col(correct).cast("double")))
    return verdicts.groupBy(by).agg(share("numeric").alias("N"), share("semantic").alias("S"))


def typed_reward(answer: Column, grounded: Column, retrieved: Column, fabricated: Column, weight: float = 0.0) -> Column:
    """(1 - w) A (0.5 + 0.5 G) + w Ret; 0 with a fabricated citation."""
    if not 0 <= weight <= 0.1:
        raise ValueError("the retrieval weight must be between 0 and 0.1")
    return F.when(fabricated, 0.0).otherwise((1 - weight) * answer * (0.5 + 0.5 * grounded) + weight * retrieved)


def typed_text_match(answer: Column, aliases: Column) -> Column:
    flat = lambda c: F.rtrim(F.regexp_replace(F.trim(F.regexp_replace(F.lower(c), r"\s+", " ")), r"\.+$", ""))
    return F.exists(aliases, lambda x: flat(x) == flat(answer))


def typed_score(submissions: DataFrame, targets: DataFrame, citations: DataFrame, receipts: DataFrame, weight: float = 0.0, episode: str = "episode_id", strict: bool = True, derivations: DataFrame | None = None) -> DataFrame:
    """F, A, G, Ret and reward per episode: citations joined to receipts, reviewed supports to the receipts' texts, claims divided.

    submissions: episode, question_id, answer_type, value, unit, scale, decision, answer_text; targets: the same answer columns with
    precision, aliases, supports (array of document_id, page, quote, claim), adjudication_status, and derived where some are. A submission
    without a target is an error; not strict, it stays as target_missing, with no scores. A derived target's G is what derivations says
    (episode, derivation_grounded, as from ``provenance.grounded``): without provenance an answer that is right by its value alone is not grounded.
    """
    from ..functions.numbers import normalize_scale, normalize_unit, numbers_equal, scalar
    from . import evidence as E

    number = lambda p: F.struct(scalar(F.col(f"{p}value")).alias("value"), normalize_unit(F.col(f"{p}unit")).alias("unit"), normalize_scale(F.col(f"{p}scale")).alias("scale"))
    s = submissions.join(targets.withColumnsRenamed({c: f"t_{c}" for c in targets.columns if c != "question_id"}).withColumn("_there", F.lit(True)), "question_id", "left")
    absent = F.col("_there").isNull()
    s = s.withColumn("target_missing", F.when(absent, F.raise_error(F.concat(F.lit("no target for "), F.col("question_id").cast("string"))).cast("boolean")).otherwise(False) if strict else absent)
    complete = F.when(F.col("answer_type") == "numeric", number("")["value"].isNotNull() & (F.col("unit") != "") & number("")["scale"].isNotNull() & (F.col("scale") != "")).when(F.col("answer_type") == "boolean", F.col("decision").isin("yes", "no")).when(F.col("answer_type") == "text", F.trim("answer_text") != "")
    s = s.withColumn("F", F.coalesce(complete, F.lit(False)).cast("double"))
    s = s.withColumn("_n", numbers_equal(number("t_"), number(""), F.col("t_precision")))
    same_type = F.col("answer_type") == F.col("t_answer_type")
    right = F.when(F.col("answer_type") == "numeric", F.col("_n")).when(F.col("answer_type") == "boolean", F.col("decision") == F.col("t_decision")).otherwise(typed_text_match(F.col("answer_text"), F.col("t_aliases")))
    s = s.withColumn("A", F.coalesce((F.col("F") == 1) & same_type & right, F.lit(False)).cast("double"))

    joined = E.cited(citations, receipts, episode)
    fabricated = joined.groupBy(episode).agg(F.max(~F.col("valid")).alias("fabricated"))
    supports = s.select(episode, F.explode("t_supports").alias("x")).select(episode, "x.*").withColumn("claim", F.coalesce("claim", F.lit("answer")))
    delivered = supports.join(receipts.select(episode, "document_id", "page", "receipt_id", "text"), [episode, "document_id", "page"]).where((F.length("quote") > 0) & F.col("text").contains(F.col("quote")))
    ret = delivered.select(episode).distinct().withColumn("Ret", F.lit(1.0))
    visible = joined.where("strong").select(episode, "receipt_id").distinct()
    covered = delivered.join(visible, [episode, "receipt_id"], "left_semi").select(episode, "claim")
    grounded = E.all_claims_covered(supports, covered, episode).where("all_covered").select(episode, F.lit(1.0).alias("_g"))
    if "derived" in targets.columns:
        calculated = derivations.select(episode, "derivation_grounded") if derivations is not None else submissions.select(episode, F.lit(False).alias("derivation_grounded")).limit(0)
        derived = F.coalesce(F.col("t_derived") & (F.col("answer_type") == "numeric"), F.lit(False))
        grounded = s.select(episode, derived.alias("_d")).join(grounded, episode, "left").join(calculated, episode, "left")
        grounded = grounded.select(episode, F.when(F.col("_d"), F.coalesce(F.col("derivation_grounded"), F.lit(False)).cast("double")).otherwise(F.col("_g")).alias("_g"))
    out = s.join(fabricated, episode, "left").join(ret, episode, "left").join(grounded, episode, "left")
    out = out.na.fill({"fabricated": False, "Ret": 0.0, "_g": 0.0}).withColumn("G", F.when(F.col("fabricated") | (F.col("A").isNull()), 0.0).otherwise(F.col("_g") * same_type.cast("double") * F.col("F")))
    unresolved = (F.col("t_adjudication_status") == "unresolved") | ((F.col("answer_type") == "text") & (F.col("A") == 0) & (F.col("F") == 1) & same_type)
    out = out.withColumn("unresolved", F.coalesce(unresolved, F.lit(False)))
    closed = F.coalesce(F.col("t_adjudication_status") == "unresolved", F.lit(False))
    zero = lambda c: F.when(F.col("target_missing"), None).when(closed, 0.0).otherwise(F.col(c))
    out = out.withColumns({"F": zero("F"), "A": zero("A"), "G": zero("G"), "Ret": zero("Ret")})
    out = out.withColumn("reward", F.when(F.col("target_missing"), None).when(closed | (F.col("F") == 0), 0.0).otherwise(typed_reward(F.col("A"), F.col("G"), F.col("Ret"), F.col("fabricated"), weight)))
    correct = (F.col("A") == 1) & ~F.col("unresolved")
    return out.select(episode, "question_id", "target_missing", "F", "A", "G", "Ret", "fabricated", "unresolved", "reward", correct.cast("int").alias("correct"), (correct & (F.col("G") == 1)).cast("int").alias("grounded_success"), F.lit(TYPED).alias("scorer_version"))


def grounded_reward(answer: Column, evidence: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), answer * (0.5 + 0.5 * evidence)))


def evidence_quality(gold_in_answer: Column, gold_in_trace: Column, candidate_in_trace: Column, has_numbers: Column, token_support: Column, strong: Column, weak: Column) -> Column:
    """Claim support times source strength: 1 after a read, 0.75 after search hits alone, else 0."""
    by_numbers = F.least(gold_in_answer, gold_in_trace) * F.greatest(F.lit(0.5), candidate_in_trace)
    support = F.when(has_numbers, by_numbers).otherwise(F.least(F.lit(1.0), token_support))
    return support * F.when(strong, 1.0).when(weak, 0.75).otherwise(0.0)


def hard_veto(contradicted: Column, gold_decision: Column, answer_decision: Column, numbers_differ: Column) -> Column:
    """The first reason for which no judge is asked, or null."""
    return F.when(contradicted, "explicit_contradiction").when(gold_decision.isNotNull() & answer_decision.isNotNull() & (gold_decision != answer_decision), "decision_mismatch").when(numbers_differ, "numeric_mismatch")


def text_veto() -> Column:
    """hard_veto over the columns of ``answers.text_terms``: numbers differ if both sides have some, none matches, and both or neither are percentages."""
    c = F.col
    percent = lambda ms: F.exists(ms, lambda m: m["percent"])
    differ = c("_gold_real") & c("_answer_real") & ~c("_all") & (c("_matched") == 0) & (percent("_gn") == percent("_an"))
    return hard_veto(c("_against"), c("_gd"), c("_ad"), differ)


def merged_judgment(deterministic: Column, verdict: Column, confidence: Column, numeric_ok: Column, both_numbers: Column, factor: Column, veto: Column) -> Column:
    """0 under a veto or a sure contradiction; for sure entailment the length factor, or 0 if both sides have numbers that the judge finds wrong; else as it was."""
    sure = F.coalesce(confidence >= 0.85, F.lit(False))
    entailed = F.when(both_numbers & ~numeric_ok, 0.0).otherwise(factor)
    return F.when(veto.isNotNull(), 0.0).when(sure & (verdict == "contradicted"), 0.0).when(sure & (verdict == "entailed"), entailed).otherwise(deterministic)


def needs_judge(gold: Column, answer: Column, veto: Column) -> Column:
    from ..functions.answers import normalized

    return (normalized(gold) != normalized(answer)) & veto.isNull()


def process_quality(pivoted: Column, evidence: Column, arithmetic: Column, repeated: Column, guardrails: Column, premature: Column) -> Column:
    """0.35 p + 0.20 e + 0.15 a - 0.30 r - 0.15 g - 0.20 pre, in [0, 1]; repeats and guardrails saturate at two."""
    raw = 0.35 * pivoted + 0.20 * evidence + 0.15 * arithmetic - 0.30 * F.least(F.lit(1.0), repeated / 2) - 0.15 * F.least(F.lit(1.0), guardrails / 2) - 0.20 * premature
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def arithmetic_reward(text: Column, gold: Column) -> Column:
    """1 if the last number after an answer marker is the gold, 0.25 for a marker and a number, 0.10 for a number; length adds at most 0.01."""
    predicted = F.get(F.reverse(F.regexp_extract_all(text, F.lit(r"(?i)\banswer\s*:\s*(-?\d+)\b"), 1)), F.lit(0))
    number, marker = text.rlike(r"\d"), text.rlike(r"(?i)\banswer\s*:")
    grade = F.when(F.coalesce(predicted, F.lit("")) == gold, 1.0).when(marker & number, 0.25).when(number, 0.10).otherwise(0.0)
    return F.least(F.lit(1.0), grade + 0.01 * F.least(F.length(text), F.lit(100)) / 100)


def replayed_status(score_f: Column, target_status: Column) -> Column:
    """Why an episode has no score to count: target_unresolved, no_submission, or null."""
    return F.when(target_status == "unresolved", "target_unresolved").when(score_f == 0, "no_submission")

"""Lexical comparison of answers: tokens, decisions, contradictions, and the legacy quality scores built on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import numbers as N
from .text import let, strip

# The answer marker, words without weight in answers, and equal forms of words.
ANSWER_MARKER = r"(?im)^\s*(?:\*\*)?(?:final\s+)?answer\s*(?:\*\*)?\s*:\s*(?:\*\*)?"
STOP_WORDS = (
    "the a an and or of to in on for with as is was were by from that this their into had have has does did do not no yes than based during year fy "
    "approximately about company level answer there are according reported data ended respectively"
).split()
TOKEN_ALIASES = {
    "operations": "operation", "operating": "operation", "operated": "operation", "cashflows": "cashflow", "cash-flow": "cashflow", "revenues": "revenue", "expenses": "expense",
    "liabilities": "liability", "assets": "asset", "investments": "investment", "bonds": "bond", "resorts": "resort", "margins": "margin", "ratios": "ratio", "companies": "company",
    "years": "year", "quarters": "quarter",
}
# Words of direction, by rule.
UP_WORDS, DOWN_WORDS = ("positive", "increased", "grew", "up", "improved"), ("negative", "declined", "decreased", "down", "fell")
SAID_UP, SAID_DOWN = ("increase", "increased", "up", "positive", "yes"), ("decrease", "decreased", "decline", "declined", "down", "negative", "no")
NEGATIVE = r"\b(?:not|negative|decline|declined|decrease|decreased|fell|fall|drop|dropped|lower|down|no\s+material)\b"
POSITIVE = r"\b(?:positive|increase|increased|grew|improve|improved|largest|yes|up)\b"
UNDECIDED = r"^\s*(?:lower|higher|decrease|increase|decline|drop|change)\b"
ABROAD_DOWN, ABROAD_UP = r"international.{0,40}\b(?:decline|declined|decreased|down)\b", r"international.{0,40}\b(?:increase|increased|grew|up)\b"


def extract_answer(text: Column) -> Column:
    """What follows the last answer marker; the whole text if there is none or nothing follows."""
    whole = strip(F.coalesce(text, F.lit("")))
    return let(whole, lambda t: let(F.split(t, ANSWER_MARKER), lambda p: let(strip(F.element_at(p, -1)), lambda a: F.when((F.size(p) > 1) & (a != ""), a).otherwise(t))))


def last_line_answer(text: Column) -> Column:
    """The last line that starts with 'Answer:', without that; else the last line that is not blank."""
    rows = F.filter(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r]"), lambda x: strip(x) != "")

    def pick(ls: Column) -> Column:
        marked = F.filter(ls, lambda x: x.rlike(r"(?i)^\s*Answer:"))
        return F.when(F.size(marked) > 0, strip(F.regexp_replace(F.element_at(marked, -1), r"(?i)^\s*Answer:\s*", ""))).when(F.size(ls) > 0, strip(F.element_at(ls, -1))).otherwise("")

    return let(rows, pick)


def anchored_answer(text: Column) -> Column:
    """The rest of the first line that has 'Answer:' at its start."""
    return strip(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?im)^\s*answer:\s*(.+)$", 1))


def normalized(text: Column) -> Column:
    return F.translate(strip(F.lower(F.coalesce(text, F.lit("")))), "$, ", "")


def answer_tokens(text: Column) -> Column:
    """Distinct words of weight, in singular and by their aliases."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), 1)
    words = F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*STOP_WORDS))
    alias = lambda w: reduce(lambda c, kv: c.when(w == kv[0], kv[1]), TOKEN_ALIASES.items(), F.when(F.lit(False), w)).otherwise(w)
    single = lambda w: F.when(w.endswith("ies") & (F.length(w) > 4), F.concat(F.substring(w, F.lit(1), F.length(w) - 3), F.lit("y"))).when(w.endswith("s") & (F.length(w) > 4), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)
    return F.array_distinct(F.transform(F.transform(words, alias), single))


def overlap(gold: Column, candidate: Column) -> Column:
    """(recall, short, common): shared words as a share of the gold's, of the shorter side's, and their number."""

    def judged(g: Column, c: Column) -> Column:
        both = F.size(F.array_intersect(g, c))
        some = (F.size(g) > 0) & (F.size(c) > 0)
        share = lambda n: F.when(some, both / F.greatest(n, F.lit(1))).otherwise(0.0)
        return F.struct(share(F.size(g)).alias("recall"), share(F.least(F.size(g), F.size(c))).alias("short"), F.when(some, both).otherwise(0).alias("common"))

    return let(answer_tokens(gold), lambda g: let(answer_tokens(candidate), lambda c: judged(g, c)))


def decision(text: Column) -> Column:
    """yes, no or null: an opening word, a stated conclusion, a single word of direction, or the first word of direction."""
    first = F.substring(extract_answer(text), 1, 500)
    first = F.regexp_replace(first, r"(?i)\bincrease\s*/\s*\(\s*decrease\s*\)", "decrease")
    first = F.lower(F.regexp_replace(first, r"(?i)\bdecrease\s*/\s*\(\s*increase\s*\)", "increase"))
    word = lambda w: F.when(w.isin("yes", "true"), "yes").when(w.isin("no", "false"), "no")

    def judged(t: Column) -> Column:
        opening = word(F.regexp_extract(t, r"^\s*(?:the\s+answer\s+is\s+)?(yes|no|true|false)\b", 1))
        stated = word(F.regexp_extract(t, r"\b(?:answer|conclusion)\s*(?:is|:)\s*(yes|no|true|false)\b", 1))
        at = lambda p: F.length(F.split(t, p, 2)[0])
        positive, negative = t.rlike(POSITIVE), t.rlike(NEGATIVE)
        by_direction = F.when(positive & (~negative | (at(POSITIVE) < at(NEGATIVE))), "yes").when(negative, "no")
        single = F.when(strip(t).isin(*SAID_UP), "yes").when(strip(t).isin(*SAID_DOWN), "no")
        return F.coalesce(opening, stated, single, F.when(~t.rlike(UNDECIDED), by_direction))

    return let(first, judged)


def _has_word(c: Column, words) -> Column:
    return c.rlike(rf"\b(?:{'|'.join(words)})\b")


def contradiction(gold: Column, candidate: Column) -> Column:
    """Whether the candidate says only the opposite direction of a gold that has one, overall or of the international part."""

    def judged(g: Column, c: Column) -> Column:
        up, down = _has_word(g, UP_WORDS), _has_word(g, DOWN_WORDS)
        c_up, c_down = _has_word(c, UP_WORDS), _has_word(c, DOWN_WORDS)
        overall = (down & ~up & c_up & ~c_down) | (up & ~down & c_down & ~c_up)
        g_down, g_up, a_down, a_up = g.rlike(ABROAD_DOWN), g.rlike(ABROAD_UP), c.rlike(ABROAD_DOWN), c.rlike(ABROAD_UP)
        return overall | (g_down & a_up & ~a_down) | (g_up & a_down & ~a_up)

    return let(F.lower(extract_answer(gold)), lambda g: let(F.lower(extract_answer(candidate)), lambda c: judged(g, c)))


def text_terms(frame, gold: str, candidate: str):
    """The frame with what the legacy scores need of two text columns, each computed once: columns that start with '_'."""
    from . import numbers as N

    frame = frame.withColumn("_answer", extract_answer(F.col(candidate))).withColumn("_gold", strip(F.coalesce(F.col(gold), F.lit(""))))
    frame = frame.withColumns({"_gn": N.number_mentions("_gold"), "_an": N.number_mentions("_answer"), "_parsed": N.parse_number(F.col("_gold")), "_equal": N.numeric_equal(F.col("_gold"), F.col("_answer"))})
    matched = F.size(F.filter("_gn", lambda m: N.mention_in(m, F.col("_an"))))
    real = lambda c: F.exists(c, lambda m: ~((F.abs(m["value"]) >= 1900) & (F.abs(m["value"]) <= 2100) & (m["value"] == F.floor(m["value"]))))
    frame = frame.withColumns({
        "_matched": F.when(F.col("_parsed").isNotNull(), F.col("_equal").cast("int")).otherwise(matched),
        "_overlap": overlap(F.col("_gold"), F.col("_answer")), "_gd": decision(F.col("_gold")), "_ad": decision(F.col("_answer")),
        "_gold_real": real("_gn"), "_answer_real": real("_an"), "_against": contradiction(F.col("_gold"), F.col("_answer")),
        "_gt": answer_tokens(F.col("_gold")), "_at": answer_tokens(F.col("_answer")),
    })
    return frame.withColumn("_all", F.when(F.col("_parsed").isNotNull(), F.col("_equal")).otherwise((F.size("_gn") > 0) & (F.col("_matched") == F.size("_gn"))))


def legacy_quality() -> Column:
    """The lexical answer quality over the columns of ``text_terms``: half for the conclusion, half for the details."""
    c = F.col
    recall, short, common = c("_overlap.recall"), c("_overlap.short"), c("_overlap.common")
    conflict = c("_gold_real") & c("_answer_real") & ~c("_all") & (c("_matched") == 0)
    details_decided = (
        F.when(c("_gold_real"), F.when(c("_all"), 1.0).when(conflict & (F.size("_at") <= 8), 0.0).when((c("_matched") > 0) | (recall >= 0.2), 0.9).otherwise(F.least(F.lit(0.75), F.greatest(F.lit(0.25), recall))))
        .when((common >= 2) | (F.size("_gt") <= 6), 1.0)
        .otherwise(0.9)
    )
    both_operations = (common >= 1) & F.array_contains("_at", "operation") & F.array_contains("_gt", "operation")
    open_case = (
        F.when(c("_all"), F.struct(F.when((common >= 1) | (c("_matched") > 0), 1.0).otherwise(0.9).alias("conclusion"), F.lit(1.0).alias("details")))
        .when((common >= 2) & ((short >= 0.5) | (recall >= 0.35)), F.struct(F.lit(1.0).alias("conclusion"), F.greatest(F.lit(0.9), short).alias("details")))
        .when((recall >= 0.6) | both_operations, F.struct(F.lit(1.0).alias("conclusion"), F.lit(0.9).alias("details")))
        .otherwise(F.struct(F.lit(0.0).alias("conclusion"), F.lit(0.0).alias("details")))
    )
    decided = F.struct(F.when(c("_ad") == c("_gd"), 1.0).otherwise(0.9).alias("conclusion"), details_decided.alias("details"))
    half = lambda s: 0.5 * s["conclusion"] + 0.5 * s["details"]
    mixed = let(F.when(c("_gd").isNotNull(), decided).otherwise(open_case), half)
    lifted = let(mixed, lambda q: F.when((q < 0.9) & (common >= 2) & (short >= 0.67) & ~c("_gold_real"), 0.9).otherwise(F.least(F.lit(1.0), q)))
    refused = c("_against") | (c("_gd").isNotNull() & ((c("_ad").isNotNull() & (c("_ad") != c("_gd"))) | (c("_ad").isNull() & ~c("_all"))))
    return (
        F.when((c("_answer") == "") | (c("_gold") == ""), 0.0)
        .when(normalized(c("_gold")) == normalized(c("_answer")), 1.0)
        .when(c("_parsed").isNotNull(), c("_equal").cast("double"))
        .when(refused, 0.0)
        .otherwise(lifted)
    )


def length_factor(gold: Column, candidate: Column, ratio: float = 3.0) -> Column:
    """1 up to ratio times the gold's length, then the allowed length as a share of the candidate's, at least one half."""
    allowed = ratio * F.greatest(F.length(gold), F.lit(1))
    return F.when((gold == "") | (F.length(candidate) <= allowed), 1.0).otherwise(F.greatest(F.lit(0.5), F.least(F.lit(1.0), ratio * F.length(gold) / F.greatest(F.length(candidate), F.lit(1)))))


def five_percent_grade(gold: Column, answer: Column) -> Column:
    """1 within 5 % of the gold's first number, else one half where the gold's text is part of the answer's, else 0."""
    near = (F.size(N.plain_numbers(gold)) > 0) & N.close_numbers(gold, answer, 0.05)
    part = (normalized(gold) != "") & normalized(answer).contains(normalized(gold))
    return F.when(near | (normalized(gold) == normalized(answer)), 1.0).when(part, 0.5).otherwise(0.0)

"""Cleaning, tokens, filing metadata and page features of texts, as built-in expressions but for HTML entities."""

from __future__ import annotations

import html
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

# Limits of passages, reads and snippets.
PASSAGE_LENGTH, PASSAGE_STEP, LEAST_TEXT = 2200, 1900, 40
READ_LIMIT = 2400
SNIPPET_LENGTH, SNIPPET_LEAD = 300, 100

# Patterns of the text model.
TOKEN = r"([A-Za-z0-9][A-Za-z0-9%$./-]*)"
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
CASH_TITLE = r"state(\s*ment)?s?\s+(of|and)\s+cash\s*flows?|cash\s*flows?\s*statement"
OPERATIONS_TITLE = r"state(\s*ment)?s?\s+of\s+operations|statements?\s+of\s+income|income\s*statements?"
TABLE_OPERATIONS_TITLE = r"state(\s*ment)?s?\s+of\s+operations|statement\s+of\s+income|income\s*statement"
BALANCE_TITLE, COMPREHENSIVE_TITLE, EQUITY_TITLE = r"balance\s*sheets?", r"comprehensive\s+income", r"stockholders'?\s*equity"
NOTES_TITLE = r"notes?\s+to\s+(?:the\s+)?(?:consolidated\s+)?financial\s+statements"
UNITS = r"(?i)\(([^\n]{0,100}(?:million|thousand|percent|per share|\$)[^\n]{0,100})\)"
SECTION_ITEM = r"\bitem\s+[0-9]{1,2}[a-z]?\b"
# Phrases that mark a section line, and phrases that mark a table's title.
SECTION_PHRASES = ("consolidated statement", "balance sheet", "cash flows", "financial statements", "management's discussion", "risk factors", "legal proceedings", "business overview")
TITLE_PHRASES = ("statements of operations", "income statement", "balance sheet", "cash flows", "comprehensive income", "stockholders' equity")
COMPANY_ALIASES = {"aescorporation": "aes", "theaescorporation": "aes"}


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


@F.pandas_udf(Ty.StringType())
def unescape(text: pd.Series) -> pd.Series:
    """All HTML character references; the built-in functions have no table of them."""
    return text.map(lambda x: html.unescape(x) if x is not None and "&" in x else x)


def named_references(text: Column, names: dict[str, str]) -> Column:
    """Only the given references decoded, once and where a semicolon closes them; that of & comes last, so what it leaves is not decoded again."""
    for name in sorted(names, key=lambda n: n == "amp"):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(names[name]))
    return text


def clean_text(text: Column, entities: bool | dict[str, str] = True) -> Column:
    """References decoded (all of HTML's, also unclosed ones; or those named), NUL and runs of blanks to one blank, three line feeds or more to two,
    ends stripped; null gives ''."""
    text = F.coalesce(text, F.lit(""))
    text = named_references(text, entities) if isinstance(entities, dict) else unescape(text) if entities else text
    text = F.translate(text, "\x00", " ")
    return strip(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def tokens(text: Column) -> Column:
    """Lower-cased tokens in order."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), 1), F.lower)


def lines(text: Column) -> Column:
    """Stripped lines that are not empty."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), LINE_BREAK), strip), lambda x: x != "")


def content_lines(text: Column) -> Column:
    """Lines without page numbers and the words 'table of contents'."""
    return F.filter(lines(text), lambda x: ~x.rlike(r"^\d{1,4}$") & (F.lower(x) != "table of contents"))


def company_name(document: Column) -> Column:
    """From a file name: what precedes '_', camel case split; capitals alone become title case."""
    split = F.regexp_replace(F.split(document, "_")[0], r"(?<=[a-z])(?=[A-Z])", " ")
    shouted = (F.length(split) > 2) & (split == F.upper(split)) & ~split.rlike(r"\d")
    return F.when(shouted, F.initcap(split)).otherwise(split)


def filing_year(document: Column) -> Column:
    """The first year 20xx that stands by itself."""
    return F.regexp_extract(document, r"(?<!\d)(20\d{2})(?!\d)", 1).try_cast("int")


def filing_type(document: Column) -> Column:
    upper = F.upper(document)
    return (
        F.when(upper.contains("10K") | upper.contains("ANNUALREPORT"), "10-K")
        .when(upper.contains("10Q"), "10-Q")
        .when(upper.contains("8K"), "8-K")
        .when(upper.contains("EARNINGS"), "earnings")
        .otherwise("other")
    )


def canonical_company(name: Column) -> Column:
    """Letters and digits only, lower case; aliases resolved. For equality of company names."""
    bare = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]", "")
    return reduce(lambda c, kv: c.when(bare == kv[0], kv[1]), COMPANY_ALIASES.items(), F.when(F.lit(False), bare)).otherwise(bare)


def _contains_any(c: Column, phrases) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(p) for p in phrases])


def section_hint(text: Column) -> Column:
    """The first of 25 lines that is short and names an item or a known section; '' if none."""
    fits = lambda x: (F.length(x) < 140) & (F.lower(x).rlike(SECTION_ITEM) | _contains_any(F.lower(x), SECTION_PHRASES))
    return F.coalesce(F.get(F.filter(F.slice(lines(text), 1, 25), fits), F.lit(0)), F.lit(""))


def _head(content: Column, sep: str) -> Column:
    return F.array_join(F.transform(F.slice(content, 1, 18), F.lower), sep)


def is_table(text: Column) -> Column:
    """A statement title within the first 18 content lines; or 10 such lines of which 45 % have a digit."""
    titles = (CASH_TITLE, TABLE_OPERATIONS_TITLE, BALANCE_TITLE, COMPREHENSIVE_TITLE, EQUITY_TITLE)

    def judged(content: Column) -> Column:
        titled = let(_head(content, "\n"), lambda h: reduce(lambda a, b: a | b, [h.rlike(t) for t in titles]))
        return titled | ((F.size(content) >= 10) & (F.size(F.filter(content, lambda x: x.rlike(r"\d"))) >= 0.45 * F.size(content)))

    return let(content_lines(text), judged)


def units_hint(text: Column) -> Column:
    return strip(F.regexp_extract(F.coalesce(text, F.lit("")), UNITS, 1))


def statement_kind(text: Column) -> Column:
    """cashflow, operations, balance, comprehensive, equity or other, by the title block; the earlier of the first two wins."""

    def judged(h: Column) -> Column:
        first = lambda p: F.length(F.split(h, p, 2)[0])  # noqa: E731  where the first match starts
        cash, operations = h.rlike(CASH_TITLE), h.rlike(OPERATIONS_TITLE)
        return (
            F.when(h.rlike(NOTES_TITLE), "other")
            .when(cash & (~operations | (first(CASH_TITLE) < first(OPERATIONS_TITLE))), "cashflow")
            .when(operations, "operations")
            .when(h.rlike(BALANCE_TITLE), "balance")
            .when(h.rlike(COMPREHENSIVE_TITLE), "comprehensive")
            .when(h.rlike(EQUITY_TITLE), "equity")
            .otherwise("other")
        )

    return let(strip(F.regexp_replace(_head(content_lines(text), " "), r"\s+", " ")), judged)


def table_title(text: Column) -> Column:
    """The first of 40 lines that has a title phrase, cut to 180 characters; '' if none."""
    found = F.filter(F.slice(lines(text), 1, 40), lambda x: _contains_any(F.lower(x), TITLE_PHRASES))
    return F.left(F.coalesce(F.get(found, F.lit(0)), F.lit("")), F.lit(180))


def chunks(text: Column) -> Column:
    """Overlapping passages as structs (chunk, start, end, text); texts and passages under 40 characters have none."""
    n = F.length(text)
    starts = F.when(n >= LEAST_TEXT, F.sequence(F.lit(0), n - 1, F.lit(PASSAGE_STEP))).otherwise(F.array().cast("array<int>"))
    cut = F.transform(starts, lambda s, i: F.struct(i.alias("chunk"), s.alias("start"), F.least(s + PASSAGE_LENGTH, n).alias("end"), F.substring(text, s + 1, F.lit(PASSAGE_LENGTH)).alias("text")))
    return F.filter(cut, lambda c: c["end"] - c["start"] >= LEAST_TEXT)


def snippet(text: Column, query: Column) -> Column:
    """(snippet, start): 300 characters from 100 before the earliest query word of three letters or more."""
    words = F.filter(F.regexp_extract_all(F.lower(query), F.lit(r"(\w+)"), 1), lambda w: F.length(w) > 2)
    at = F.filter(F.transform(words, lambda w: F.instr(F.lower(text), w)), lambda p: p > 0)
    start = F.greatest(F.lit(0), F.coalesce(F.array_min(at), F.lit(1)) - 1 - SNIPPET_LEAD)
    return let(start, lambda s: F.struct(F.substring(text, s + 1, F.lit(SNIPPET_LENGTH)).alias("snippet"), s.alias("start")))


def format_question(company: Column, question: Column) -> Column:
    """'About {company}: ' before questions that do not name the company."""
    named = F.lower(question).contains(F.lower(company))
    return F.when((F.coalesce(company, F.lit("")) == "") | named, question).otherwise(F.concat(F.lit("About "), company, F.lit(": "), question))


def facts(text: Column) -> Column:
    """Statements between line breaks, sentence ends and semicolons, without bullets; the whole text if there is none."""
    parts = F.split(F.coalesce(text, F.lit("")), r"\n+|(?<=[.!?])\s+|;")
    found = F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"^[ \t*\r-]+|[ \t*\r-]+$", "")), lambda x: x != "")
    return F.when(F.size(found) > 0, found).otherwise(F.array(strip(F.coalesce(text, F.lit("")))))


def slice_between(text: Column, first: Column, last: Column | None = None, limit: int = READ_LIMIT) -> Column:
    """The text from the first marker up to the next last marker (or its end), stripped; null where a marker is missing or it is longer than the limit."""
    start = F.instr(text, first)
    rest = F.substring(text, start, F.length(text))
    end = F.length(rest) + 1 if last is None else F.instr(rest, last)
    cut = strip(F.substring(rest, F.lit(1), end - 1))
    return F.when((start > 0) & (end > 0) & (F.length(cut) <= limit), cut)

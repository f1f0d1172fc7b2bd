"""Golden values of scalar functions."""

import pytest
from pyspark.sql import functions as F

from veritrail.functions import answers as A
from veritrail.functions import arithmetic as X
from veritrail.functions import calls as C
from veritrail.functions import numbers as N
from veritrail.functions import text as T


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("gold,said,equal", [
    ("$1,577", "1577 USD", True), ("$1.577 billion", "$1,577 million", True), ("(5.2)", "-5.2", True), ("5.2%", "5.2 percent", True), ("5.2%", "5.2", False), ("5.2", "-5.2", False), ("1.25", "1.3", False), ("1.3", "1.25", True),
    ("8.70 billion", "8.738 billion", False), ("8.7 billion", "8.738 billion", True), ("12", "twelve", False), ("€3", "$3", False), ("0.5 million", "500 thousand", True), ("1e3", "1000", False), ("(5", "-5", False), ("1" + "0" * 30, "1" + "0" * 30, True), ("2" + "0" * 30, "2" + "0" * 30, False),
])
def test_numeric_equal(spark, gold, said, equal):
    assert one(spark, N.numeric_equal(F.col("g"), F.col("c")), g=gold, c=said) is equal


@pytest.mark.parametrize("text,want", [
    ("$ (1,234.50) million", ("-1234.50", "USD", "million", 2)), (".5", (".5", "number", "ones", 1)), ("−3 bn", ("-3", "number", "billion", 0)), ("7x", ("7", "x", "ones", 0)), ("USD 5 EUR", None), ("1,23", None), ("", None),
])
def test_parse_number(spark, text, want):
    got = one(spark, N.parse_number(F.col("t")), t=text)
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize("text,want", [
    ("So.\nAnswer: 5\nFinal answer: ** 7 **", "7 **"), ("no marker", "no marker"), ("Answer:", "Answer:"), (None, ""),
])
def test_extract_answer(spark, text, want):
    assert one(spark, A.extract_answer(F.col("t")), t=text) == want


@pytest.mark.parametrize("text,want", [
    ("Yes, it did", "yes"), ("The answer is no", "no"), ("conclusion: true", "yes"), ("declined", "no"), ("Lower costs led to it", None), ("It grew although costs fell", "yes"), ("It fell, then grew", "no"),
    ("Increase/(decrease) of costs", None), ("nothing here", None),
])
def test_decision(spark, text, want):
    assert one(spark, A.decision(F.col("t")), t=text) == want


@pytest.mark.parametrize("name,company,year,kind", [("AmericanWater_2020_10K", "American Water", 2020, "10-K"), ("AES_2019_10Q", "Aes", 2019, "10-Q"), ("3M_2018_ANNUALREPORT", "3M", 2018, "10-K"), ("Foo_8K_x", "Foo", None, "8-K"), ("Bar_12020_EARNINGS", "Bar", None, "earnings")])
def test_metadata(spark, name, company, year, kind):
    d = F.col("d")
    assert (one(spark, T.company_name(d), d=name), one(spark, T.filing_year(d), d=name), one(spark, T.filing_type(d), d=name)) == (company, year, kind)


def test_clean_text(spark):
    assert one(spark, T.clean_text(F.col("t")), t=" a &amp; b\t\t&eacute; \x00 c\n\n\n\nd &#8364; ") == "a & b é c\n\nd €"
    assert one(spark, T.clean_text(F.col("t")), t=None) == ""


@pytest.mark.parametrize("title,kind", [
    ("Consolidated Statements of Cash Flows", "cashflow"), ("Statements of Operations and Statements of Cash Flows", "operations"), ("Balance Sheets", "balance"), ("Comprehensive Income", "comprehensive"), ("Stockholders' Equity", "equity"), ("Notes to Financial Statements\nBalance Sheet", "other"), ("", "other"),
])
def test_statement_kind(spark, title, kind):
    assert one(spark, T.statement_kind(F.col("t")), t="12\nTable of Contents\n" + title) == kind


def test_table_by_digits(spark):
    assert one(spark, T.is_table(F.col("t")), t="\n".join(["a 1"] * 5 + ["b"] * 5)) and not one(spark, T.is_table(F.col("t")), t="\n".join(["a 1"] * 4 + ["b"] * 6))


def test_slices(spark):
    assert one(spark, T.slice_between(F.col("t"), F.lit("<"), F.lit(">")), t="a <b > c>") == "<b" and one(spark, T.slice_between(F.col("t"), F.lit("<"), F.lit(">")), t="a > <") is None


@pytest.mark.parametrize("text,want", [
    ("about $3M and 3M Co", [(3e6, False)]), ("5.5% in 2020", [(0.055, True), (2020, False)]), ("−1,200 thousand", [(-1.2e6, False)]), ("2 billion dollars", [(2e9, False)]), ("none", []), (None, []), ("3Million", []), ("-$4.5k or 7x", [(-4500, False), (7, False)]), ("1,5 mm and 2 million", [(15e6, False), (2e6, False)]), ("5 percent of 10 thousand", [(0.05, True), (0.1, True)]), ("about 10 thousand", [(1e4, False)]), ("$2,000", [(2000, False)]), ("million 5B", [(5e9, False)]),
])
def test_mentions(text, want):
    assert [(pytest.approx(v), p) for v, p, _ in N.mentions(text)] == [(v, p) for v, p in want]


@pytest.mark.parametrize("text,want", [("2 + 3 * -4", -10.0), ("2 ** 10 % 7", 2.0), ("1 / 0", None), ("__import__('os')", None), ("9 ** 9 ** 9", None), ("a + 1", None), ("(", None), ("1.01 ** 120", 1.01**120), ("2000000000 ** 0.5", 2e9**0.5), ("10 ** 300", 1e300), ("10 ** 400", None), ("10 ** 400 / 10 ** 390", 1e10), ("1e200 * 1e200", None), ("(0 - 8) ** 0.5", None), ("2 ** -3", 0.125)])
def test_arithmetic(text, want):
    assert X.calculate(text) == want


def test_decimal_arithmetic():
    assert X.calculate_decimal("(a - b) / b * 100", {"a": "110", "b": "100"}) == "10.0"
    assert X.calculate_decimal("a / b", {"a": "1"}) is None and X.calculate_decimal("a", {"a": "1", "b": "2"}) is None and X.calculate_decimal("a ** 9", {"a": "2"}) is None and X.calculate_decimal("a / 0", {"a": "2"}) is None
    assert X.signature("a / b", {"a": "x", "b": "y"}) == X.signature("p / q", {"p": "x", "q": "y"}) != X.signature("q / p", {"p": "x", "q": "y"})


@pytest.mark.parametrize("text,want", [
    ('<think>{"name": "x"}</think><tool_call>{"name": "read", "arguments": {"b": 1, "a": "z"}}</tool_call>', [("read", '{"a":"z","b":1}')]),
    ("<tool_call><function=read><parameter=page>3</parameter><parameter=id>x y</parameter></function></tool_call>", [("read", '{"id":"x y","page":3}')]),
    ("<|tool_call_start|>[read(page=2), finish(ok=True)]<|tool_call_end|>", [("read", '{"page":2}'), ("finish", '{"ok":true}')]),
    ('```json\n{"function": {"name": "f", "arguments": "{\\"k\\": [1]}"}}\n```', [("f", '{"k":[1]}')]), ('{"name": "g"}', [("g", "{}")]), ("plain text", []), (None, []),
    ("<|tool_call_start|>[read(doc=x.y, page=1)]<|tool_call_end|>", [("read", '{"doc":"x.y","page":1}')]), ("<|tool_call_start|>read(page=2)", [("read", '{"page":2}')]), ("<|tool_call_start|>(f(a=1), g(b=[2]))<|tool_call_end|>", [("f", '{"a":1}'), ("g", '{"b":[2]}')]),
    ("<|tool_call_start|>[f(**{'k': 1}), 3]<|tool_call_end|>", [("f", "{}")]), ('I will call {"name": "read", "arguments": {"page": {"n": 1}}} and {"x": 2} {now', [("read", '{"page":{"n":1}}')]),
])
def test_lenient_calls(text, want):
    assert C.lenient_calls(text) == want


@pytest.mark.parametrize("value,kind,want", [("[1, 2]", "array", [1, 2]), ("x", "array", ["x"]), ("", "array", [""]), (5, "string", "5"), ("3", "integer", "3"), ('{"a": 1}', "object", {"a": 1}), ("[1]", "object", "[1]"), (True, "string", "True"), (None, "string", None), (7, "array", 7)])
def test_coercion(value, kind, want):
    assert C.coerced(value, kind) == want


@pytest.mark.parametrize("value,want", [([1, "a"], ["1", "a"]), ('["x", 2]', ["x", "2"]), ("x", ["x"]), ("", [""]), (None, []), (0, []), (3, ["3"])])
def test_listed(value, want):
    assert C.listed(value) == want


def test_signature_is_normalized(spark):
    same = lambda t: one(spark, C.call_signature(F.lit("read"), F.col("t")), t=t)
    assert same('{"b": 1, "a": " X  y "}') == same('{"a": "x y", "b": 1}') != same('{"a": "x z", "b": 1}')


def test_chunks(spark):
    got = one(spark, T.chunks(F.col("t")), t="x" * 3820)
    assert [(c["start"], c["end"]) for c in got] == [(0, 2200), (1900, 3820)] and one(spark, T.chunks(F.col("t")), t="x" * 39) == []


def test_folded_leaves():
    assert C.with_leaves({"B": [" X  y ", 1, None, {2: "Z"}]}, C.folded) == {"B": ["x y", 1, None, {"2": "z"}]}


def test_expressions_of_many_rows_are_parsed_once(monkeypatch):
    calls, parse = [], X.ast.parse
    monkeypatch.setattr(X.ast, "parse", lambda *a, **k: calls.append(a) or parse(*a, **k))
    got = [X.calculate_decimal("p_once / q_once", {"p_once": str(i), "q_once": "4"}) for i in range(50)]
    assert got == [str(X.Decimal(i) / 4) for i in range(50)] and len(calls) == 1
    assert X.calculate_decimal("p_once / q_once", {"p_once": "1"}) is X.calculate_decimal("p_once /", {"p_once": "1"}) is None


def test_an_expression_is_parsed_once(monkeypatch):
    from veritrail.functions import arithmetic as X

    parsed, parse = [], X.ast.parse
    monkeypatch.setattr(X.ast, "parse", lambda e, **k: parsed.append(e) or parse(e, **k))
    one = "first_one / second_one + 2"
    assert X.signature(one, {"first_one": "a", "second_one": "b"}) == X.signature(one, {"first_one": "a", "second_one": "b"}) == "((<a> Div <b>) Add 2)"
    assert X.operations(one) == X.operations(one) == 2 and X.calculate_decimal(one, {"first_one": "1", "second_one": "2"}) == "2.5"
    assert parsed == [one]
    assert X.operations("a +") is None and X.signature("a + b", {"a": "x"}) is None

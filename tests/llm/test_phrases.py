"""Collocations against counting every phrase, over blocks of any size, the query against its SQL, and odd rows."""

import random
import re
from collections import Counter

import pytest

from tests.oracle import connect, rows
from veritrail.llm import _common
from veritrail.llm import phrases as P


def brute(docs, least, shown=2000):
    n, f = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate({c: c + 32 for c in range(65, 91)})):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    many = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    out = []
    for (lang, w), a in many.items():
        if any(g == lang and len(v) > len(w) and 100 * b >= 100 * a and any(v[i : i + len(w)] == w for i in range(len(v))) for (g, v), b in many.items()):
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        out.append((lang, -score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    ranked, last = [], Counter()
    for lang, score, a, phrase, left, right in sorted(out):
        last[lang] += 1
        if last[lang] <= shown:
            ranked.append((lang, last[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(ranked)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["A", "b", "C", "dé", "Zß", "e\x1cf", "longer", "of", "the"]
    docs = [(rng.choice(["en", "fr", None, "und"]), "".join(rng.choice(vocabulary) + rng.choice([" ", "  ", "\t", " ", ". ", ",", "\n", "\x0b"]) for _ in range(rng.randrange(120)))) for _ in range(60)]
    return docs + [(None, None), ("en", None), ("fr", ""), ("de", " .\n"), ("en", "a a a a a a a a")] + [("en", "one two three four five six")] * 9


@pytest.mark.parametrize(("seed", "block"), [(1, 40), (2, 1000), (3, 1 << 21)])
def test_equal_to_counting_all_phrases(spark, seed, block):
    docs = corpus(seed)
    frame = spark.createDataFrame(docs, "lang string, text string").repartition(3)
    got = P.collocations(frame, least=6, block=block).drop("cut").collect()
    assert sorted(tuple(r) for r in got) == brute(docs, 6)


def test_joined_where_nothing_is_broadcast(spark, monkeypatch):
    monkeypatch.setattr(_common, "BROADCAST_BYTES", 0)
    docs = corpus(4)
    got = P.collocations(spark.createDataFrame(docs, "lang string, text string"), least=6, shown=5).drop("cut").collect()
    assert sorted(tuple(r) for r in got) == brute(docs, 6, 5)


def test_a_block_is_a_row_of_frequent_lists(spark, monkeypatch):
    """Rows grow with the blocks, not with the phrases of each; no list of a rare phrase is written, and none is shuffled."""
    tables = []
    monkeypatch.setattr(P, "materialize", lambda df, tag, *by, **o: tables.append((tag, got := _common.materialize(df, tag, *by, **o))) or got)
    monkeypatch.setattr(P, "discard", lambda table: None)
    docs = [("x", "a b c " * 5 + f"odd{i} rare{i}") for i in range(40)]
    P.mined(spark.createDataFrame(docs, "lang string, text string").coalesce(2), least=100)
    lists = [t.selectExpr("count(*)", "sum(size(positions))").first() for tag, t in tables if tag == "lists"]
    assert [tuple(r) for r in lists] == [(2, 600), (2, 560), (2, 520), (2, 480)]
    assert {tag for tag, _ in tables} == {"postings", "totals", "frequent", "lists", "phrases"}


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_phrases_up_to_a_length(spark, longest):
    docs = [("x", "a b c d e f")] * 6
    phrases = P.mined(spark.createDataFrame(docs, "lang string, text string"), least=6, longest=longest)[1]
    want = [("abcdef"[i : i + k], k, 6) for k in range(1, longest + 1) for i in range(7 - k)]
    assert sorted((r["phrase"].replace(" ", ""), r["words"], r["f"]) for r in phrases.collect()) == sorted(want)


def test_scores_are_exact(spark):
    a, n = 3 * 10**12 + 1, 9 * 10**14 + 7
    totals = spark.createDataFrame([("x", n)], "lang string, n long")
    phrases = spark.createDataFrame([("x", "p", 1, a + 5), ("x", "q", 1, a + 11), ("x", "p q", 2, a)], "lang string, phrase string, words int, f long")
    got = P.scored(totals, phrases).first()
    assert got["score"] == 1000 * a * n // ((a + 5) * (a + 11)) and 1000 * a * n > 2**64 and got["cut"] == 1


def test_extra_columns_and_empty_tables(spark):
    schema = "lang string, text string, word int, block string, n int, phrase string"
    got = P.collocations(spark.createDataFrame([("x", "p q " * 8, 1, "b", 2, "z")], schema), least=3).collect()
    assert got and {r["n"] for r in got} == {16}
    assert P.collocations(spark.createDataFrame([], schema)).count() == 0


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.01"
    got = P.op13(spark, folder).toPandas()
    assert len(got) > 50 and rows(got) == rows(connect(folder).execute(P.OP13_SQL).df())

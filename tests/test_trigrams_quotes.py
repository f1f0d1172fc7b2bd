"""Pages ruled out by three-character sequences, and quotes found without their page, against trying everything."""

import random
import re

import pytest

from veritrail.operators import quotes as Q
from veritrail.operators import retrieval as R
from veritrail.operators import trigrams as G


@pytest.mark.parametrize(
    ("patterns", "want"),
    [
        (["licen[cs]ed"], "licen"),
        (["Token = "], "token = "),
        (["abc|defg"], ("any", ["abc", "defg"])),
        (["abc.*defg"], ("all", ["abc", "defg"])),
        (["(abc)?xyz"], "xyz"),
        (["(?:abcd)+z{3}"], "abcd"),
        (["ab"], None),
        (["abcd", "x"], None),
        (["abc(", "defg"], ("any", ["abc(", "defg"])),
        (["naïve text"], "ve text"),
        (["(?i:abc)"], None),
        ([], None),
        (["^abc$"], "abc"),
        ([r"\bnet\s+sales"], ("all", ["net", "sales"])),
        (["(?=look)abcd"], "abcd"),
    ],
)
def test_what_patterns_require(patterns, want):
    assert G.required(patterns) == want


def test_grams(spark):
    texts = ["", "ab", "abc", "aBcABC", "é日本x", "aaaaaa"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", G.grams(G.F.col("t")).alias("g")).collect()
    for r in rows:
        low = "".join(c.lower() if c.isascii() else c for c in r["t"])
        assert set(r["g"]) == {low[i : i + 3] for i in range(len(low) - 2)}


def test_candidates_lose_no_match(spark, tmp_path):
    rng = random.Random(3)
    words = ["Licensed", "licenced", "token", "=", "x", "déjà", "abc", "net", "sales", "\n", "NET"]
    rows = [(i, 1, " ".join(rng.choice(words) for _ in range(rng.randrange(12)))) for i in range(400)] + [(1000, 1, None), (1001, 1, "")]
    spark.createDataFrame(rows, "doc_id int, page int, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    source, keys = spark.read.parquet(str(tmp_path / "d")), ["doc_id", "page"]
    index = G.written_grams(source, "test", lambda d: d, keys)
    for patterns in (["licen[cs]ed"], ["token =|licenced"], ["net sales", "abc.*abc"], ["(abc|net) (sales|x)"], ["nothing of it"]):
        some = G.candidates(index, keys, patterns)
        kept = {r["doc_id"] for r in some.collect()}
        matching = {i for i, _, t in rows if t and any(re.search(p, t, re.I) for p in patterns)}
        assert matching <= kept and len(kept) < len(rows) - 50
        grep = lambda pages: sorted(map(tuple, R.grep(pages, patterns, keys).collect()))
        assert grep(source.join(some, keys, "left_semi")) == grep(source)
    assert G.candidates(index, keys, ["x"]) is None


@pytest.mark.parametrize("taken", [1, 2, 5, 1 << 20])
def test_sequences_of_a_text_taken_in_parts(monkeypatch, taken):
    monkeypatch.setattr(G, "TAKEN", taken)
    for t in ["", "ab", "aBcABC", "é日本x😀😀😀\n", "aaaaaa", "The thE Z[@`{ the"]:
        assert sorted(G._texts(G._codes(t))) == G.grams_of(t.translate(G._FOLD))


@pytest.mark.parametrize("held", [1, 30, 1 << 20])
def test_lists_of_pages(spark, held):
    """A row for each sequence of a block, not of a page; nulls among keys, and places that change within a task."""
    rows = [("b", i // 50, i if i % 7 else None, f"p{i}", "abc " * (i % 3 + 1) + str(i)) for i in range(100)]
    lists = G._listed(spark.createDataFrame(rows, "build string, segment int, doc_id int, page string, text string").coalesce(1), ["doc_id", "page"], "text", held)
    got = [(r["segment"], r["gram"], d, p) for r in lists.collect() for d, p in zip(r["doc_id"], r["page"], strict=True)]
    assert sorted(got, key=str) == sorted([(s, g, d, p) for _, s, d, p, t in rows for g in G.grams_of(t)], key=str)
    assert held < 1 << 20 or lists.groupBy("segment", "gram").count().where("count > 1").count() == 0


def test_index_and_search_shuffle_no_texts(spark, tmp_path):
    rows = [(i, 1, f"page {i} of the same words, " * 20) for i in range(300)]
    spark.createDataFrame(rows, "doc_id int, page int, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    source, keys = spark.read.parquet(str(tmp_path / "d")), ["doc_id", "page"]
    index = G.written_grams(source, "few", lambda d: d, keys)
    assert index.count() < 3000  # a row for each page and sequence were over 9000
    joined = source.join(G.candidates(index, keys, ["page 29[0-9]"]), keys, "left_semi")
    assert "Exchange hashpartitioning" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == sum("page 29" in t for *_, t in rows)


@pytest.mark.parametrize("seed", range(3))
def test_quotes_equal_trying_every_place(spark, seed):
    rng = random.Random(seed)
    letters = "ab" if seed == 0 else "abcdefgh é日😀\n"
    pages = [(i, "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 40, 300])))) for i in range(40)] + [(40, None), (41, "a" * 100)]
    pages.append(pages[3])
    quotes = []
    for n in range(60):
        text = rng.choice([t for _, t in pages if t])
        at = rng.randrange(len(text))
        quotes.append((n, text[at : at + rng.choice([1, 2, 4, 6, 12, 16, 31, 50, 200])]))
    quotes += [(100, ""), (101, None), (102, "not there at all, not even in part"), (103, quotes[0][1]), (104, "a" * 40)]
    want = set()
    for n, q in quotes:
        for p, t in pages:
            want |= {(n, p, i) for i in range(len(t)) if q and t.startswith(q, i)} if t else set()
    frame = Q.occurrences(spark.createDataFrame(quotes, "n int, quote string"), spark.createDataFrame(pages, "p int, text string"), ["n"], ["p"])
    assert sorted(map(tuple, frame.collect())) == sorted(want)


@pytest.mark.parametrize("held", [0, 1 << 16])
def test_few_and_many_quotes_find_the_same(spark, monkeypatch, held):
    """Few quotes are met where the pages lie: no text and no sample is shuffled. A key that stands for several quotes or pages meets each."""
    monkeypatch.setattr(Q, "QUOTES_HELD", held)
    pages = [(1, "x", "one and two é😀, one"), (1, "x", "two"), (None, "y", "one"), (2, "x", None), (3, "x", "one " * 60)]
    quotes = [(1, "one"), (1, "two"), (2, "é😀"), (3, "e"), (4, "one one one one one one one one one one one"), (5, ""), (6, None)]
    p, q = spark.createDataFrame(pages, "p int, s string, text string"), spark.createDataFrame(quotes, "n int, quote string")
    found = Q.occurrences(q, p.where("p IS NOT NULL"), ["n"], ["p", "s"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    want = {(n, k, s, i) for n, w in quotes for k, s, t in pages for i in range(len(t or "")) if k and w and t.startswith(w, i)}
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert ("Join" in plan) == (held == 0) and (not held or plan.count("Exchange") == 1)


def test_keys_must_differ(spark):
    one = spark.createDataFrame([(1, "x", "x")], "k int, quote string, text string")
    with pytest.raises(ValueError):
        Q.occurrences(one, one, ["k"], ["k"])

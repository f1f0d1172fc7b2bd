"""Near duplicates: hashes, signatures, bitmaps, components and whole results against brute force."""

import itertools
import random
import re

import numpy as np
import pytest

from veritrail.llm import near_dedup as D
from veritrail.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall((t or "").encode().lower().decode())


def exact_set(t):
    w = words(t)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """component by row: least doc_id over chains of similar rows."""
    sets, of = [exact_set(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            of[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [(d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def family(rng, n, words_, rate):
    base = [f"w{rng.randrange(4000)}" for _ in range(words_)]
    return [" ".join(f"x{rng.randrange(9**9)}" if rng.random() < rate else w for w in base) for _ in range(n)]


def corpus():
    rng = random.Random(2)
    shared = family(rng, 1, 60, 0)[0]
    texts = [None, "", " \n", "One two", "one TWO", "one two three four five", "Ärger ärger", "the same text of six words", "the  same\ntext of six words"]
    texts += family(rng, 60, 120, 0.02) + family(rng, 60, 80, 0.04) + family(rng, 40, 300, 0.015)
    texts += [shared + " " + family(rng, 1, 30, 0)[0] for _ in range(40)] + [" ".join(family(rng, 1, 3000, 0))] + ["very long " * 4000] * 3
    rows = list(enumerate(texts))
    return rows + [rows[12], rows[12], (None, texts[12]), (None, "alone without an id at all")]


def test_hashes_tell_sets_apart():
    texts = [t or "" for _, t in corpus()]
    sets, k1, _ = D.shingles([t.encode() for t in texts])
    assert [len(s) for s in sets] == [len(exact_set(t)) for t in texts]
    assert len(set(k1.tolist())) == len({tuple(words(t)) for t in texts})
    assert len(set().union(*[s.tolist() for s in sets])) == len(frozenset().union(*map(exact_set, texts)))


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    both, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (3000, 500, 500))
    s = D.signatures([np.unique(np.concatenate([both, a])), np.unique(np.concatenate([both, b]))], 1024)
    assert abs((s[0] == s[1]).mean() - 0.75) < 0.06


@pytest.mark.parametrize("n", [1, 3, 40, 700, 9000])
def test_maps_never_rule_out_a_link(n):
    rng = np.random.default_rng(n)
    for share in (1.0, 0.9, 0.86, 0.8, 0.5):
        common = rng.integers(0, 2**63, max(1, int(n * share)), dtype=np.uint64)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 2**63, n - len(common), dtype=np.uint64)])) for _ in range(2))
        maps, sizes = [D.bitmap(x).tobytes() for x in (a, b)], np.array([len(a), len(b)])
        kept = list(D.close_pairs(np.arange(2), sizes, maps, np.array([0]), np.array([1])))
        assert kept or not D.similar(a, b)
        assert share > 0.5 or n < 4 or not kept


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 120)] + [(500, i) for i in range(501, 560)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(80)] + [(7, 7)]
    of = {}

    def root(i):
        while of.setdefault(i, i) != i:
            i = of[i]
        return i

    for u, v in edges:
        a, b = root(u), root(v)
        of[max(a, b)] = min(a, b)
    got = {r["u"]: r["v"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: root(i) for i in of if root(i) != i}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, 1, "b", 2) for d, t in rows], "doc_id long, text string, row int, bucket string, n_shingles int").repartition(5)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_shingles"], r["component_id"] if r["component_id"] is not None else -1, r["kept"]) for r in D.near_duplicates(docs).collect())
    assert got == sorted((d if d is not None else -1, n, c if c is not None else -1, d is not None and d == c) for d, n, c in brute(rows))


def test_one_document_of_each_group_stays(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, kept int")
    got = sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in D.distinct_documents(docs).collect())
    want = {d for d, n, c in brute(rows) if d is not None and d == c}
    assert got == sorted([*want, -1, -1])


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert D.near_duplicates(docs).count() == 0 and D.distinct_documents(docs).count() == 0

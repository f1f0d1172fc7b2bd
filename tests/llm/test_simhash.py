"""Fingerprints against the definition, cells against all pairs, components and the query against brute force."""

import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from veritrail.llm import _common
from veritrail.llm import simhash as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_print(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints, of = [brute_print(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while of[i] != i:
            of[i] = of[of[i]]
            i = of[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 4:
            of[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted([(d, f"{prints[i]:016x}", least.get(root(i))) for i, (d, _) in enumerate(rows)], key=str)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints():
    rng = random.Random(1)
    texts = [None, "", " \n", "One", "ÄA b", "a b c", "A B c d", "x\x1cy \x85 z w v"] + [" ".join(rng.choice(["Foo", "bar", "é", "q" * 40]) for _ in range(n)) for n in (4, 5, 30, 500)]
    assert [S.fingerprint(t and t.encode()) for t in texts] == [brute_print(t) for t in texts]
    assert S.bit_counts(np.array([3, 1, 1 << 63], np.uint64), 2)[[0, 1, 2, 63]].tolist() == [2, 1, 0, 1]


def test_linked_prints_share_a_cell():
    rng = random.Random(2)
    pairs = []
    for _ in range(3000):
        a = rng.getrandbits(64) if rng.random() < 0.8 else rng.choice([0, (1 << 64) - 1, 0x5555555555555555])
        b = a
        for k in rng.sample(range(64), rng.randrange(5)):
            b ^= 1 << k
        pairs.append((a, b))

    def of(prints):
        out = [set() for _ in prints]
        for c, i in zip(*(x.tolist() for x in S.cells(np.array(prints, np.uint64))), strict=True):
            out[i].add(c)
        return out

    left, right = of([a for a, _ in pairs]), of([b for _, b in pairs])
    assert all(x & y for x, y in zip(left, right, strict=True)) and sum(map(len, left)) / len(left) < 110


@pytest.mark.parametrize("block", [2, 512])
def test_links_connect_all_that_are_near(spark, monkeypatch, block):
    monkeypatch.setattr(_common, "BROADCAST_BYTES", block << 10)
    rng = random.Random(block)
    prints = {rng.getrandbits(64) for _ in range(40)}
    for centre in list(prints)[:4]:  # clouds of prints, most within 4 of some others, and chains
        for _ in range(60):
            p = centre
            for k in rng.sample(range(64), rng.randrange(1, 7)):
                p ^= 1 << k
            prints.add(p)
    prints = sorted(prints)
    found = S.links(spark.createDataFrame([(signed(p),) for p in prints], "print long"), block).collect()
    of = {signed(p): signed(p) for p in prints}

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    for r in found:
        assert ((r["u"] ^ r["v"]) & ((1 << 64) - 1)).bit_count() <= 4
        of[root(r["u"])] = root(r["v"])
    for a, b in itertools.combinations(prints, 2):
        if (a ^ b).bit_count() <= 4:
            assert root(signed(a)) == root(signed(b))


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(7)
    base = [f"w{rng.randrange(3000)}" for _ in range(400)]
    near = [" ".join(f"x{rng.randrange(9**9)}" if rng.random() < 0.004 else w for w in base) for _ in range(60)]
    odd = list(enumerate([None, "", "\n \t", "alone", "alone", "one two three", "a b c d e f g " * 3000, *near, near[0]], 5000)) + [(None, near[1]), (None, "without an id"), (5000, None)]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = S.op12(spark, str(tmp_path)).collect()
    assert sorted([(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got], key=str) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_odd_columns_and_empty_tables(spark):
    schema = "doc_id long, text string, print string, cell int, component string, u int"
    got = S.near_duplicates(spark.createDataFrame([(2, "a b", "p", 1, "c", 1), (1, "A  B", None, None, None, None), (3, "c", "p", 1, "c", 1)], schema)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 1, 3: 3}
    assert S.near_duplicates(spark.createDataFrame([], schema)).count() == 0

"""Runs of words against a search of every period, the query against it on small tables, and odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from veritrail.llm import periodic_runs as P

SPACE = b" \t\n\x0b\f\r"


def brute(w):
    """(start, length, period) of all runs, by each period's stretches of equal pairs; the least period of a stretch counts."""
    n, out = len(w), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            z = i
            while z + p < n and w[z] == w[z + p]:
                z += 1
            if z > i and z - i + p >= max(12, 2 * p):
                out.setdefault((i, z - i + p), p)
            i = z + 1
    return sorted((s, n_, p) for (s, n_), p in out.items())


def expected(doc_id, text):
    w = [x for x in "".join(chr(c) if chr(c).encode() not in [bytes([b]) for b in SPACE] else " " for c in map(ord, text or "")).split(" ") if x]
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute(w)
    dropped = {i for s, k, p in found for i in range(s + p, s + k)}
    s, k, p = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), s, k, p, 1000 * k // p if found else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in found)), sha(" ".join(x for i, x in enumerate(w) if i not in dropped)), n)


@pytest.mark.parametrize("seed", range(30))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    docs = []
    for _ in range(12):
        w = [rng.randrange(rng.choice([1, 2, 3, 40])) for _ in range(rng.choice([0, 1, 5, 12, 40, 150]))]
        for _ in range(rng.randrange(3)):
            part = [rng.randrange(50) for _ in range(rng.randrange(1, 20))]
            w += (part * rng.randrange(1, 8))[: rng.randrange(1, 80)]
        docs.append(w)
    r = P.runs([np.array(d, np.int32) for d in docs])
    got = [[(int(s), int(n), int(p)) for d, s, n, p in zip(r.document, r.start, r.length, r.period, strict=True) if d == k] for k in range(len(docs))]
    assert got == [brute(d) for d in docs]


def test_pieces_of_the_grid_make_no_difference(monkeypatch):
    rng = random.Random(3)
    docs = [np.array([rng.randrange(2) for _ in range(300)], np.int32), np.zeros(200, np.int32), np.array([1] * 11, np.int32)]
    whole = P.runs(docs)
    monkeypatch.setattr(P, "POINTS", 7)
    parts = P.runs(docs)
    assert all((getattr(whole, k) == getattr(parts, k)).all() for k in ("document", "start", "length", "period"))


def test_extensions_equal_comparison():
    rng = random.Random(5)
    w = [rng.randrange(2) for _ in range(120)] * 2 + [-1]
    ext = P.Extensions(np.array(w))
    i, j = np.array([(a, b) for a in range(len(w)) for b in range(len(w)) if a != b]).T

    def common(a, b):
        k = 0
        while max(a, b) + k < len(w) and w[a + k] == w[b + k]:
            k += 1
        return k

    assert ext(i, j).tolist() == [common(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True)]


def test_a_very_long_document_of_one_word():
    r = P.runs([np.zeros(200_000, np.int32)])
    assert (r.start.tolist(), r.length.tolist(), r.period.tolist()) == ([0], [200_000], [1])


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_query_equals_brute_force(spark, tmp_path):
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars < 3000")
    odd = [(1001, None), (1002, ""), (1003, " \n\x0b"), (1004, "a\x1cb  c " * 30), (1005, "x " * 500), (1005, "x " * 500), (1006, "one two three\tfour\n" * 9)] + [(k, "p q r s t u v w x y z " * 4) for k in range(2000, 2040)]
    docs = given.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert rows_of(P.op11(spark, str(tmp_path))) == sorted((expected(r["doc_id"], r["text"]) for r in docs.collect()), key=str)


def test_odd_rows(spark):
    schema = "doc_id long, text string, starts int, n_words string, collapsed int"
    rows = [(None, "a b " * 10, 1, "x", 2), (1, None, None, None, None), (1, "w " * 12, 3, "y", 4)]
    got = {(r["doc_id"], r["n_words"]): r for r in P.periodic_runs(spark.createDataFrame(rows, schema)).collect()}
    assert got[(None, 20)]["periods"] == [2] and got[(None, 20)]["collapsed"] == "a b" and got[(1, 12)]["collapsed"] == "w" and got[(1, 0)]["collapsed"] == ""
    assert P.periodic_runs(spark.createDataFrame([], schema)).count() == 0

"""Exact top-k against a scan; N-best segmentations against all segmentations."""

import itertools
import random
import time
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pytest

from veritrail.llm import segmentation as G
from veritrail.llm import topk


def scan(vectors, queries, k):
    rows = sorted(set(vectors))
    out = []
    for q, v in sorted(set(queries)):
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q)
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("spread,dims,n", [(5, 3, 300), (1, 2, 200), (10**6, 8, 120), (10**9, 4, 80), (3, 1, 5)])
def test_top_k(spark, monkeypatch, spread, dims, n):
    rng = random.Random(spread)
    for name, value in (("SHARD_ROWS", 40), ("LEAF_ROWS", 4), ("GROUP_SHARDS", 2), ("BLOCK_QUERIES", 7)):
        monkeypatch.setattr(topk, name, value)
    rows = [(i, tuple(rng.randint(-spread, spread) for _ in range(dims))) for i in range(n)]
    rows += rows[:3] + [(1000 + i, rows[0][1]) for i in range(60)]
    df = spark.createDataFrame([(i, list(v)) for i, v in rows], "id long, v array<long>")
    got = topk.top_k(df, df.where("id % 10 = 0"), 10)
    assert sorted(map(tuple, got.collect())) == scan(rows, [r for r in rows if r[0] % 10 == 0], 10)


def test_odd_vectors(spark, tmp_path):
    rows = [(0, [1.0, 2.0], 1), (100, [0.5, None], 1), (1, None, 1), (2, [float("nan"), 1.0], 1), (3, [float("inf"), 1.0], 1), (4, [-1.0, -0.0004], 1), (5, [], 1), (None, [1.0, 1.0], 1), (200, [2.0], 1), (0, [1.0, 2.0], 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted(map(tuple, topk.op1(spark, str(tmp_path)).collect()))
    assert got == [(0, 1, 200, 1024 * 2048), (0, 2, 5, 0), (0, 3, 4, -1024 * 1024 - 2048), (200, 1, 0, 2048 * 1024), (200, 2, 5, 0), (200, 3, 4, -2048 * 1024)]
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "e/embeddings.parquet"))
    assert topk.op1(spark, str(tmp_path / "e")).count() == 0


def test_boxes_are_tight():
    rng = np.random.default_rng(0)
    v = rng.integers(-50, 50, (300, 5))
    t = topk.build(np.arange(300), v, leaf=8)
    for a, z, low, high, least in zip(t["a"], t["z"], t["low"], t["high"], t["least"], strict=True):
        assert (t["vectors"][a:z].min(axis=0) == low).all() and (t["vectors"][a:z].max(axis=0) == high).all() and t["ids"][a:z].min() == least
    assert sorted(t["ids"].tolist()) == list(range(300)) and max(z - a for a, z, le in zip(t["a"], t["z"], t["left"], strict=True) if le < 0) <= 8


@pytest.fixture(scope="module")
def coder():
    return G.Segmenter(G.public_model())


def every(coder, text):
    """All segmentations of a short text, best first."""
    text = coder.prepared(text)
    edges, out, todo = coder.edges(text), [], [(0, 0.0, ())]
    while todo:
        at, score, ids = todo.pop()
        if at == len(text):
            out.append((score, array("I", ids).tobytes()))
        todo += [(z, score + s, (*ids, *more)) for a, z, s, more in edges if a == at]
    return sorted(out, key=lambda x: -x[0])


@pytest.mark.parametrize("text", ["", " ", "a", "The cat", "hello!", "a  b", "日本 x", "ab\ncd", "x▁y", "don't", "of thing.", "$$$ &&", "é,è", "\x1c\t"])
def test_n_best(coder, text):
    want, got = every(coder, text), coder.n_best(text, 4)
    assert [round(s, 6) for s, _ in got] == [round(s, 6) for s, _ in want[: len(got)]] and len(got) == min(4, len(want))
    assert len({i for _, i in got}) == len(got) and {i for _, i in got} <= {i for _, i in want}
    if "▁" not in text:
        assert all(coder.decode(array("I", i).tolist()) == text for _, i in got)


@pytest.mark.parametrize("text", ["a" * 300_000, "ab" * 30_000, "qzjxk" * 20_000])
def test_long_runs_without_a_break(coder, text):
    began = time.time()
    got = coder.n_best(text, 4)
    assert time.time() - began < 60 and len({i for _, i in got}) == (2 if "q" in text else 4) and all(coder.decode(array("I", i).tolist()) == text for _, i in got)


def test_best_is_exact_with_many_ties(coder):
    for text in ("aaaaaa", "abababab", "éééé", "xxyyxxyy", "日日日"):
        want = sorted(((s, tuple(np.frombuffer(i, np.uint32).tolist())) for s, i in every_part(coder, text)), key=lambda x: (-round(x[0], 9), x[1]))[:4]
        got = coder.best(text, 4)
        assert [round(s, 9) for s, _ in got] == [round(s, 9) for s, _ in want] and len({i for _, i in got}) == len(got)
        if len({round(s, 9) for s, _ in want}) == len(want):
            assert [i for _, i in got] == [i for _, i in want]


def every_part(coder, part):
    edges, out, todo = coder.edges(part), [], [(0, 0.0, ())]
    while todo:
        at, score, ids = todo.pop()
        if at == len(part):
            out.append((score, array("I", ids).tobytes()))
        todo += [(z, score + s, (*ids, *more)) for a, z, s, more in edges if a == at]
    return out


def test_arrays_equal_the_scalar_form(coder):
    words = list({p for t in ["Many words of the text, some un-usual: naïve Ünïcode 12345 日本語 'quoted' $$$ averyveryverylongwordthatisnone"] for w in coder.words(pa.array([t]))[0].to_pylist() for p in coder.parts(w)})
    for p, (total, cost, ids) in coder.measure_all(words):
        t, c, i = coder.measure(p)
        assert (round(total, 9), round(cost, 9), ids) == (round(t, 9), round(c, 9), i)


def test_learned_equals_fresh(spark, coder):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(25).collect()] + ["", " lead", "two  spaces", "x▁y z", "a b"]
    small = G.Segmenter(G.public_model(), cache=64)
    ids, edges, _, found = coder.batch(pa.array(texts), 4)
    for t, a, z, xs in zip(texts, edges, edges[1:], found, strict=False):
        assert [(s, G.changed(ids[a:z], c)) for s, c in xs] == small.n_best(t, 4)


def test_best_path_and_the_model(spark, coder):
    """The model decodes the best ids to the text, its normalizer changes nothing but the spaces, and its own encoding scores no better."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=G.public_model())
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect()]
    score = {i: coder.pieces[t][0] for i, t in coder.text.items()}
    for t in texts:
        ((best, ids),) = coder.n_best(t, 1)
        ids = array("I", ids).tolist()
        assert model.decode(ids) == t and model.normalize(t) == coder.prepared(t)
        own, at = 0.0, model.encode(t)
        runs = [list(g) for b, g in itertools.groupby(at, lambda i: i in coder.text) for g in ([g] if not b else ([i] for i in g))]
        for run in runs:
            own += score[run[0]] if run[0] in score else coder.unknown * len(bytes(int(model.id_to_piece(i)[3:5], 16) for i in run).decode())
        assert own <= best + 1e-6


def _by_columns(texts, coder):
    """What the query returns for short texts, by trying every segmentation."""
    for t in texts:
        want = every(coder, t or "")[:4]
        yield [round(s, 6) for s, _ in want], {i for _, i in every(coder, t or "")}


def test_query_against_every_segmentation(spark, tmp_path, coder):
    texts = ["a b", None, "", "The cat", "é x", "ab\ncd", " a", "日", "no no", "x▁y", "$$ &"]
    rows = [(i, t, i, "n") for i, t in enumerate(texts)] + [(0, "a b", 0, "n"), (None, "x", 1, "n"), (99, "long " * 200_000, 1, "n")]
    spark.createDataFrame(rows, "doc_id long, text string, ids int, scores string").write.parquet(str(tmp_path / "documents.parquet"))
    got = G.op9(spark, str(tmp_path)).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) and all(r["decoded"] == (r["doc_id"] != 9) and r["scores"] == "rank" for r in got)
    for i, (scores, segmentations) in enumerate(_by_columns(texts, coder)):
        r = by[i]
        found = [G.changed(np.array(r["ids"], np.uint32), c) for c in [[], *r["changes"]]]
        assert [round(x, 6) for x in r["n_best"]] == scores and r["score"] == r["n_best"][0] and len(set(found)) == len(found) and set(found) <= segmentations
        assert r["n_best_crc32"] == [zlib.crc32(x) for x in found] and r["n_pieces"] == len(r["ids"])
    assert by[99]["n_pieces"] >= 200_000 and coder.decode(by[99]["ids"]) == "long " * 200_000
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "none/documents.parquet"))
    assert G.op9(spark, str(tmp_path / "none")).count() == 0

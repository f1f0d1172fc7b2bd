"""Packing and sharding: against the tokenizer, against exhaustive search, and by what must hold of any result."""

import itertools
import random
import time
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veritrail.llm import packing, sharding

ODD = "doc_id long, text string, shard string, slot string, record string, length string"
TEXTS = [None, "", "  ", "Hello, world!", "a " * 5000, "Ünïcode DON'T stop\x1cnow 'tis $$$ <|endoftext|>", "İstanbul Ångström ﬁ Ǆ é 12ab", "a<|startoftext|>b hello <|endoftext|> you", "<|ENDOFTEXT|> <|endoftext<|endoftext|><|endoftext|>", "e<|endoftext|>\u0301 z", "very long " * 40_000]


def tokenizer():
    """As the contract has it: nothing set on it."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.public_tokenizer())


def odd_docs(spark):
    rows = [(i, t, "x", None, "y", "z") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x", None, "y", "z")] * 3 + [(None, "no id", None, None, None, None)]
    return spark.createDataFrame(rows, ODD)


@given(st.dictionaries(st.integers(1, 12), st.integers(1, 3), min_size=1, max_size=5), st.integers(0, 12))
@settings(max_examples=200, deadline=None)
def test_fullest_is_the_best_subset(counts, room):
    items = [n for n, k in counts.items() for _ in range(k)]
    best = max(sum(c) for r in range(len(items) + 1) for c in itertools.combinations(items, r) if sum(c) <= room)
    used = packing.fullest(sorted(counts, reverse=True), counts, room)
    assert sum(n * k for n, k in used.items()) == best and all(0 < k <= counts[n] for n, k in used.items())


def by_definition(rows):
    """Where the plan's rows put pieces of one length: ranks from the first one on go to the bins from the first one on, so many per bin."""

    def place(lengths, ranks):
        out = []
        for n, r in zip(lengths.tolist(), ranks.tolist(), strict=True):
            _, at, first, k, offset = max(x for x in rows if x[0] == n and x[1] <= r)
            out.append((first + (r - at) // k, offset + (r - at) % k * n))
        return tuple(np.array(x) for x in zip(*out, strict=True))

    return place


def test_placed_equals_the_plan(spark):
    histogram = {2048: 3, 1500: 7, 700: 11, 548: 5, 300: 40, 31: 9, 1: 2}
    rows, _ = packing.plan(histogram)
    pieces = [(n, r, "x", 7) for n, k in histogram.items() for r in range(k)]
    got = packing.placed(spark.createDataFrame(pieces, "length long, rank long, bin string, other int"), rows).collect()
    where, offset = by_definition(rows)(np.array([p[0] for p in pieces]), np.array([p[1] for p in pieces]))
    key = lambda n: sorted((r["sequence_id"], r["offset"]) for r in got if r["length"] == n)
    for n in histogram:
        assert key(n) == sorted((int(w), int(o)) for w, o, p in zip(where, offset, pieces, strict=True) if p[0] == n)
    assert all(r["bin"] == "x" and r["other"] == 7 for r in got)



@given(st.dictionaries(st.integers(1, 64), st.integers(1, 200), min_size=1, max_size=40))
@settings(max_examples=50, deadline=None)
def test_plan_places_every_piece_once(histogram):
    import numpy as np

    rows, bins = packing.plan(histogram, 64)
    place, taken = by_definition(rows), {}
    for n, k in histogram.items():
        where, offset = place(np.full(k, n), np.arange(k))
        for w, o in zip(where.tolist(), offset.tolist(), strict=True):
            taken.setdefault(w, []).append((o, n))
    assert len(taken) == bins >= -(-sum(n * k for n, k in histogram.items()) // 64)
    for spans in taken.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 64


def test_words_equal_the_tokenizer(spark):
    coder = packing.WordEncoder(packing.public_tokenizer(), cache_words=8)
    texts = [t or "" for t in TEXTS] + [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    whole = [e.ids for e in tokenizer().encode_batch(texts, add_special_tokens=False)]
    got = [array("I", b).tolist() for k in range(0, len(texts), 5) for b in coder.batch(pa.array(texts[k : k + 5]))]
    assert got == whole and coder.merges is not None
    assert tokenizer().encode("hello <|endoftext|> you", add_special_tokens=False).ids == array("I", next(coder.batch(pa.array(["hello <|endoftext|> you"])))).tolist() == [3306, 49407, 592]


@given(st.lists(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|", "|>", "<", "E", "é", "İ", "\u0301", " ", "\x1c", "\u2028", "'S", "ab1", "ENDOFTEXT", "endoftext"]), max_size=8).map("".join), max_size=4))
@settings(max_examples=200, deadline=None)
def test_any_text_equals_the_tokenizer(texts):
    want = [e.ids for e in PLAIN.encode_batch(texts, add_special_tokens=False)]
    assert [array("I", b).tolist() for b in CODER.batch(pa.array(texts, pa.string()))] == want


PLAIN, CODER = tokenizer(), packing.WordEncoder(packing.public_tokenizer())


def test_pack(spark, monkeypatch):
    docs = odd_docs(spark)
    monkeypatch.setattr(packing, "PART", 2)
    packed = packing.pack(packing.pieces(docs, packing.public_tokenizer())).cache()
    got, want = packed.collect(), []
    for r in docs.collect():
        ids = PLAIN.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        want += [(str(r["doc_id"]), k, a, min(2048, len(ids) - a), array("I", ids[a : a + 2048]).tobytes()) for k, a in enumerate(range(0, len(ids), 2048))]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], bytes(r["ids"])) for r in got) == sorted(want)
    digest = {(str(r["doc_id"]), r["piece"]): r["ids_crc32"] for r in packing.digests(packed).collect()}
    assert digest == {(i, k): zlib.crc32(b) for i, k, _, _, b in want}
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], bytes(r["ids"])))
    assert all(sum(n for _, n, _ in sorted(b)[:i]) == o for b in bins.values() for i, (o, _, _) in enumerate(sorted(b))) and all(sum(n for _, n, _ in b) <= 2048 for b in bins.values())
    assert len(bins) == -(-sum(r["length"] for r in got) // 2048)
    assert {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(packed).collect()} == {k: b"".join(x for _, _, x in sorted(b)) for k, b in bins.items()}
    assert packing.pack(packing.pieces(docs.limit(0), packing.public_tokenizer())).count() == 0


def test_query_packs_to_the_lower_bound(spark):
    got = packing.op2(spark, "/root/testdata/sf0.01").agg({"sequence_id": "max", "length": "sum", "doc_id": "count"}).first()
    assert got["max(sequence_id)"] + 1 == -(-got["sum(length)"] // 2048)


@pytest.mark.parametrize("rows", [1, 3, 1000])
def test_shards(spark, rows):
    docs = odd_docs(spark)
    out = sharding.shuffle_shards(docs, 4, bucket_rows=rows).cache()
    assert sorted(str(r["record"]) for r in out.collect()) == sorted(str(r) for r in docs.collect())
    counts = {}
    for r in out.collect():
        counts.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in counts.values()) and max(map(len, counts.values())) - min(map(len, counts.values())) <= 1
    assert sharding.shuffle_shards(docs.limit(0), 4).count() == 0


def test_shards_repeat_and_mix(spark, tmp_path):
    docs = spark.range(4000)
    a, b = (sorted(map(tuple, sharding.shuffle_shards(docs, 8, seed=5, bucket_rows=300).select("record.id", "shard", "slot").collect())) for _ in range(2))
    assert a == b
    first = [i for i, s, _ in a if s == 0]
    assert 1500 < sum(first) / len(first) < 2500
    order = [i for i, s, k in sorted(a, key=lambda x: (x[1], x[2])) if s == 0]
    assert order != sorted(order)
    sharding.write_shards(docs, str(tmp_path / "s"), 8, seed=5, bucket_rows=300)
    read = spark.read.parquet(str(tmp_path / "s"))
    assert sorted((r["record"]["id"], r["shard"], r["slot"]) for r in read.collect()) == a
    files = read.select("*", F.input_file_name().alias("f")).groupBy("f", "shard", "first").agg(F.min("slot").alias("lo"), F.max("slot").alias("hi"), F.count("*").alias("n"), F.collect_list("slot").alias("slots")).collect()
    assert len(files) == 8 * 14 and all(r["lo"] == r["first"] and r["hi"] - r["lo"] + 1 == r["n"] and r["slots"] == sorted(r["slots"]) for r in files)


def test_waves_change_nothing(spark, tmp_path):
    docs = odd_docs(spark).unionByName(spark.range(900).selectExpr("id AS doc_id", "repeat('x', int(id % 50)) AS text", "'s' AS shard", "'t' AS slot", "'r' AS record", "'l' AS length"))
    docs.write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    rows = lambda out: sorted((str(r["record"]), r["shard"], r["slot"], r["first"]) for r in out.collect())
    one = rows(sharding.shuffle_shards(docs, 3, seed=9, bucket_rows=40))  # 23 buckets
    assert one == rows(sharding.shuffle_shards(docs, 3, seed=9, bucket_rows=40, partitions=10)) == rows(sharding.shuffle_shards(docs, 3, seed=9, bucket_rows=40, partitions=1))


def test_starts_over_groups(spark):
    rows = [(b, (b * 7) % 5 + 1) for b in range(0, 50) if b % 9]
    got = {r["bucket"]: r["first"] for r in sharding.starts(spark.createDataFrame(rows, "bucket long, rows long"), group=4).collect()}
    assert got == {b: sum(n for c, n in rows if c < b) for b, _ in rows}


def test_query_rows_against_the_law(spark, tmp_path):
    """Every column of the query, over odd, null and long texts and an empty table."""
    docs = odd_docs(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = sharding.op3(spark, str(tmp_path)).collect()
    want = sorted(str((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode()))) for r in docs.collect())
    assert sorted(str((r["doc_id"], r["size"], r["text_crc32"])) for r in got) == want
    slots = {}
    for r in got:
        assert r["law"] == "rows" and r["grown_shard"] is None and 0 <= r["shard"] < 8
        slots.setdefault(r["shard"], []).append(r["slot"])
    counts = [len(slots.get(k, [])) for k in range(8)]
    assert max(counts) - min(counts) <= 1 and all(sorted(x) == list(range(len(x))) for x in slots.values())
    docs.limit(0).write.parquet(str(tmp_path / "none/documents.parquet"))
    assert sharding.op3(spark, str(tmp_path / "none")).count() == 0


def test_query_shuffles_whole_records(spark, tmp_path, monkeypatch):
    docs = odd_docs(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    real, given = sharding.shuffle_shards, []

    def shuffled(records, shards, **kw):
        given.append((records.columns, sorted(r[0] for r in records.select(kw["size"]).collect())))
        return real(records, shards, **kw)

    monkeypatch.setattr(sharding, "shuffle_shards", shuffled)
    got = sharding.op3(spark, str(tmp_path)).collect()
    texts = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
    assert sorted(map(str, ((r["doc_id"], r["size"], r["text_crc32"]) for r in got))) == sorted(str((i, len(t) + 1, zlib.crc32(t))) for i, t in texts)
    assert given[0][0] == docs.columns and all(n >= len(t) for n, t in zip(given[0][1], sorted((t for _, t in texts), key=len), strict=True))


def test_long_words_go_to_the_tokenizer():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(n)) for n in (63, 64, 65, 40_000)]
    coder = packing.WordEncoder(packing.public_tokenizer())
    began = time.time()
    got = list(coder.batch(pa.array(words)))
    assert time.time() - began < 5
    assert [np.frombuffer(b, np.uint32).tolist() for b in got] == [coder.tokenizer.encode(w, add_special_tokens=False).ids for w in words]

"""Edge cases of operators on literal frames."""

import json
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veritrail.operators import curation as U
from veritrail.operators import evidence as E
from veritrail.operators import groups as G
from veritrail.operators import provenance as O
from veritrail.operators import reporting as P
from veritrail.operators import retrieval as R
from veritrail.operators import runs as X
from veritrail.operators import scoring as S
from veritrail.operators import targets as Y
from veritrail.operators import traces as V
from veritrail.sources import readers, writers
from veritrail.streaming import episodes


@pytest.mark.parametrize("mode,n,s,g,f,want", [("mixed", 1.0, 0.5, 1.0, 1, 0.8), ("numeric", 1.0, None, 0.0, 1, 0.5), ("semantic", None, 0.5, 1.0, 0, 0.0), ("numeric", None, None, 1.0, 1, None), ("numeric", 1.0, 0.5, 1.0, 1, None), ("mixed", 1.0, 2.0, 1.0, 1, None), ("odd", 1.0, 1.0, 1.0, 1, None)])
def test_component_score(spark, mode, n, s, g, f, want):
    r = spark.createDataFrame([(mode, n, s, g, f)], "m string, n double, s double, g double, f int").select(S.component_score(*map(F.col, "mnsgf")).alias("r")).first()["r"]
    assert r["reward"] == (pytest.approx(want) if want is not None else None) and r["unresolved"] == (want is None)


@pytest.mark.parametrize("e,g,a,b,f,want", [(1, 1, 1, 1, 1, 1.0), (1, 0, 0, 0, 0, 0.15), (0, 0, 0, 0, 1, 0.05), (1, 1, 1, 0, 1, 0.85), (0.5, 0, 0.5, 1, 1, None), (1, 1, 1, 1, 2, None)])
def test_additive_reward(spark, e, g, a, b, f, want):
    got = spark.createDataFrame([tuple(map(float, (e, g, a, b, f)))], "e double, g double, a double, b double, f double").select(S.additive_reward(*map(F.col, "egabf")).alias("r")).first()["r"]
    assert got == (pytest.approx(want) if want is not None else None)


def test_bm25_matches_formula(spark):
    import math

    items = spark.createDataFrame([(1, "apple banana apple"), (2, "banana"), (3, "cherry pie")], "id int, text string")
    q = spark.createDataFrame([(1, "apple apple banana")], "query_id int, query string")
    got = {r["id"]: r["score"] for r in R.scores(R.index(items, ["id"]), q, ["id"]).collect()}
    n, avg = 3, 2.0
    part = lambda df, tf, dl: math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))
    assert got == {1: pytest.approx(2 * part(1, 2, 3) + part(2, 1, 3)), 2: pytest.approx(part(2, 1, 1))}


def test_filters_do_not_change_statistics(spark):
    items = spark.createDataFrame([(1, "apple", "A"), (2, "apple", "B")], "id int, text string, company string")
    q = spark.createDataFrame([(1, "apple")], "query_id int, query string")
    ix = R.index(items, ["id"])
    all_, some = (R.scores(ix, q, ["id"], allowed=a).collect() for a in (None, R.allowed_items(items, company="a")))
    assert [r["score"] for r in some] == [r["score"] for r in all_ if r["id"] == 1]


def test_grep_offsets_and_bad_pattern(spark):
    text = "one\r\ntwo (x\nthree\n"
    pages = spark.createDataFrame([("d", 1, text)], "document_id string, page int, text string")
    (r,) = R.grep(pages, ["(x"], ["document_id", "page"], context=1).collect()
    assert (r["line"], text[r["start"] : r["end"]]) == (2, text) and r["text"] == text
    assert R.grep(pages, ["X"], ["document_id", "page"], first=2).count() == 0


def test_read_bounds(spark):
    pages = spark.createDataFrame([("d", 1, "x" * 3000), ("d", 2, "y")], "document_id string, page int, text string")
    asked = spark.createDataFrame([("d", 0, 100, None), ("d", 2, 50, 9), ("d", 7, 0, None), ("e", 1, 0, None)], "document_id string, page int, start int, end int")
    got = {(r["document_id"], r["page"]): r for r in R.read(pages, asked).collect()}
    assert (got["d", 0]["to"], got["d", 0]["next_start"]) == (2500, 2500) and got["d", 2]["text"] == "" and got["d", 7]["error"] and got["e", 1]["error"]


def test_call_pairing(spark):
    calls = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "c")], "t int, id string")
    seen = spark.createDataFrame([(1, "a"), (1, "b"), (3, "z")], "t int, id string")
    assert {(r["t"], r["id"]): r["pairing"] for r in E.call_pairs(calls, seen, ["t", "id"]).collect()} == {(1, "a"): "paired", (1, "b"): "repeated", (2, "c"): "unanswered", (3, "z"): "orphan"}


def test_trim_observation():
    hits = {"hits": [{"t": "x" * 100} for _ in range(20)]}
    out = V.trim_observation(hits, 1000)
    assert len(out) <= 1000 and json.loads(out)["observation"]["truncated"] and 0 < len(json.loads(out)["hits"]) < 20
    page = {"text": "y" * 5000, "start": 10, "total_chars": 6000, "provenance": "p"}
    cut = json.loads(V.trim_observation(page, 800))
    assert cut["end"] == cut["start"] + len(cut["text"]) == cut["next_start"] and cut["has_more"] and "provenance" not in cut
    assert "error" in json.loads(V.trim_observation({"k" + str(i): i for i in range(500)}, 100)) and json.loads(V.trim_observation("plain", 100))["content"] == "plain"


def test_trim_observation_cuts_no_more_than_it_must():
    """Lists lose elements only until the rest fits, texts the fewest characters that do it."""
    dump = V._json
    two = {"a": [["x" * 30]] * 5, "b": ["y" * 10] * 4, "text": "t" * 50}
    cut = json.loads(V.trim_observation(two, 260))
    assert len(cut["b"]) == 4 and cut["text"] == "t" * 50 and 0 < len(cut["a"]) < 5
    longer = dict(cut, a=two["a"][: len(cut["a"]) + 1])
    assert len(dump(cut)) <= 260 < len(dump(longer))
    page = {"text": "é\n" * 900, "content": "c" * 40, "start": 5}
    for cap in (150, 400, 1000):
        out = V.trim_observation(page, cap)
        got = json.loads(out)
        assert len(out) <= cap < len(out) + 4 and got["text"] == page["text"][: len(got["text"])] and got["end"] == 5 + len(got["text"])
    assert V.trim_observation({"hits": [], "n": 1}, 4000) == dump({"hits": [], "n": 1, "observation": {"raw_chars": 17, "truncated": False}})


def test_observations_of_a_batch_are_decoded_one_by_one(spark):
    texts = pa.array([json.dumps({"text": "y" * 200_000, "start": 0}), None, "no json", "[1]", *[json.dumps({"text": "z" * 200_000})] * 100])
    tracemalloc.start()
    got = V._trimmed(texts, 500).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4_000_000 < texts.nbytes and max(map(len, got)) <= 500
    assert [json.loads(x).get("content") for x in got[1:4]] == ["", "no json", "[1]"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts.to_pylist()[:5])], "i int, t string").select("i", V.bounded_observation(F.col("t"), 500).alias("o"))
    assert [r["o"] for r in frame.orderBy("i").collect()] == got[:5]


def test_advantages(spark):
    x = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0), ("b", 2.0), ("c", None), ("c", 1.0)], "g string, r double")
    got = {(r["g"], r["r"]): r["advantage"] for r in G.advantages(x, "g", "r").collect()}
    assert got["a", 1.0] == -1 and got["a", 3.0] == 1 and got["b", 2.0] is None and got["c", 1.0] is None
    assert {r["g"] for r in G.retained(x, "g", "r").collect()} == {"a"}
    broken = {(r["g"], r["r"]): r["advantage"] for r in G.tie_broken(x.where("g <> 'c'"), "g", "r", F.lit(0.0)).collect()}
    assert broken["b", 2.0] == 0 and broken["a", 3.0] == 1


def test_quantile_rule(spark):
    x = spark.createDataFrame([(float(i),) for i in range(20)], "v double").withColumn("g", F.lit(1))
    assert P.floor_quantile(x, ["g"], "v", 0.975, "q").first()["q"] == 18 and P.floor_quantile(x, ["g"], "v", 1.0, "q").first()["q"] == 19


def test_intervals(spark):
    x = spark.createDataFrame([("r", i, float(i % 2)) for i in range(40)], "run string, unit int, d double")
    (r,) = P.bootstrap(x, "run", "unit", "d", resamples=1000).collect()
    assert r["delta"] == 0.5 and 0.3 < r["low"] < 0.5 < r["high"] < 0.7 and r["n_units"] == 40


def test_markdown(spark):
    x = spark.createDataFrame([("a|b\nc", 1.0, None)], "s string, d double, n int")
    assert list(P.markdown(x))[2] == "| a\\|b c | 1.0000 | unmeasured |"


def test_digest_ignores_partitioning(spark):
    x = spark.range(50).select("id", F.sha1(F.col("id").cast("string")).alias("t"))
    assert P.corpus_digest(x.repartition(7), ["id"], ["id", "t"]).first() == P.corpus_digest(x.coalesce(1), ["id"], ["id", "t"]).first()


def test_digest_of_many_buckets(spark):
    x = spark.range(300).select("id", F.sha1(F.col("id").cast("string")).alias("t"))
    a = P.corpus_digest(x.repartition(5), ["id"], ["id", "t"], rows_each=2).first()
    assert a == P.corpus_digest(x.coalesce(1), ["id"], ["id", "t"], rows_each=2).first() != P.corpus_digest(x.where("id <> 7"), ["id"], ["id", "t"], rows_each=2).first()


def test_positions_are_a_permutation_in_order(spark):
    x = spark.range(5000)
    for each in (1 << 16, 37):
        got = sorted(map(tuple, G.positions(x.repartition(7), F.xxhash64("id"), ["id"], each).select("id", "position").collect()), key=lambda r: r[1])
        assert [p for _, p in got] == list(range(5000))
        hashes = {r["id"]: r["h"] for r in x.select("id", F.xxhash64("id").alias("h")).collect()}
        assert [i for i, _ in got] == sorted(hashes, key=hashes.get)
    pages = G.epoch_pages(x, "id", 1, 64).groupBy("page").count().collect()
    assert len(pages) == 79 and sorted(r["count"] for r in pages)[0] == 5000 - 78 * 64 and G.epoch_pages(x.limit(0), "id", 1, 64).count() == 0


def test_evaluation_violations(spark):
    rows = spark.createDataFrame([("r", "q1", 0, 1, 1.0, 1.0, 1, 1, False, "accepted_finish", "s"), ("r", "q1", 0, 0, 1.0, 1.0, 1, 0, False, "odd", "s"), ("r", "q3", 0, 1, None, None, 0, 0, True, "other", "s")],
                                 "run_id string, question_id string, sampling_seed int, F int, A double, G double, correct int, grounded_success int, unresolved boolean, stop_reason string, evaluation_signature string")
    got = {(r["question_id"], r["violation"]) for r in U.evaluation_violations(rows, spark.createDataFrame([("q1",), ("q2",)], "question_id string"), V.STOP_REASONS).collect()}
    assert got == {("q1", "repeated"), ("q1", "stop_reason"), ("q1", "correct_needs_finish"), ("q2", "missing"), ("q3", "extra")}


def test_repair(spark):
    e = "array<struct<name:string,arguments:string>>"
    x = spark.createDataFrame([([("read", "1"), ("finish", "2")], [("read", "3")]), ([("read", "1")], [("read", "3")])], f"events {e}, extra {e}")
    assert [[i["arguments"] for i in r["events"]] for r in U.repaired(x, "events", "extra").collect()] == [["1", "3", "2"], ["1"]]


def test_empty_frames(spark):
    items = spark.createDataFrame([], "id int, text string")
    q = spark.createDataFrame([(1, "x")], "query_id int, query string")
    assert R.scores(R.index(items, ["id"]), q, ["id"]).count() == 0
    none = spark.createDataFrame([], "g string, r double")
    assert G.advantages(none, "g", "r").count() == 0 and P.floor_quantile(none, ["g"], "r", 0.5, "q").count() == 0


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/Foo_2019_10K.txt").write_text("first page text\fItem 1. Business overview\nx\f \n")
    (tmp_path / "a/Bar.pdf").write_bytes(b"not a pdf")
    assert [r[0] for r in readers.filings(spark, str(tmp_path / "a")).orderBy("document_id").collect()] == ["Bar", "Foo_2019_10K"]
    files = spark.createDataFrame([("Foo_2019_10K", (tmp_path / "a/Foo_2019_10K.txt").read_text()), ("x", "no feed")], "document_id string, text string")
    got = readers.text_pages(files).orderBy("document_id", "page").collect()
    assert [(r["page"], r["section"], r["error"]) for r in got] == [(1, "", None), (2, "Item 1. Business overview", None), (1, "", "no page boundaries")] and got[0]["year"] == 2019
    pdf = spark.read.format("binaryFile").load(str(tmp_path / "a/Bar.pdf"))
    assert readers.pdf_pages(pdf).count() == 0
    (tmp_path / "l.jsonl").write_text('{"k": 1}\n\nbroken\n{"k": 2}\n')
    lines = readers.jsonl_with_lineage(spark, str(tmp_path / "l.jsonl"), "k int").orderBy("line").collect()
    assert [(r["line"], r["status"]) for r in lines] == [(1, "ok"), (3, "invalid_json"), (4, "ok")]
    (tmp_path / "s.json").write_text('{"train": [{"q": "a"}, {"q": "b"}], "dev": [{"q": "c"}]}')
    assert sorted(map(tuple, readers.json_splits(spark, str(tmp_path / "s.json"), "struct<q:string>").collect())) == [("dev", "c"), ("train", "a"), ("train", "b")]
    (tmp_path / "ids").write_text("# no\n a \n\nb\n")
    assert [r[0] for r in readers.id_list(spark, str(tmp_path / "ids")).collect()] == ["a", "b"]
    (tmp_path / "t.csv").write_text("a,b\n1,x\n")
    assert readers.csv_table(spark, str(tmp_path / "t.csv"), "a int", ["a"]).first() == (1, "x")
    with pytest.raises(ValueError):
        readers.csv_table(spark, str(tmp_path / "t.csv"), "a int", ["z"])
    import hashlib

    assert readers.manifest(spark, str(tmp_path / "ids")).first()["sha256"] == hashlib.sha256(b"# no\n a \n\nb\n").hexdigest() and readers.manifest(spark, str(tmp_path / "ids"), most=1).first()["sha256"] is None
    x = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    for _ in range(2):
        writers.jsonl(x, str(tmp_path / "out"), resume_key="k")
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    writers.report(x, str(tmp_path / "rep"))
    assert spark.read.text(str(tmp_path / "rep/md")).count() == 4 and "&lt;" in writers.html_pairs(spark.createDataFrame([("<b>",)], "x string"), ["x"])


EVENTS = [(1, 1, "deliver", "a"), (1, 1, "cite", "a"), (1, 2, "cite", "a"), (1, 3, "finish", None), (2, 1, "cite", "b"), (2, 2, "deliver", "b"), (2, 9, "finish", None), (2, 10, "finish", None)]


def test_stream_equals_batch(spark, tmp_path):
    schema = "episode_id long, turn long, kind string, receipt string"
    for i, part in enumerate((EVENTS[:3], EVENTS[3:6], EVENTS[6:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = episodes.stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 10).parquet(str(tmp_path / "in")), 9).writeStream.format("memory").queryName("episodes").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    streamed = sorted(map(tuple, spark.table("episodes").collect()))
    assert streamed == sorted(map(tuple, episodes.batch(spark.createDataFrame(EVENTS, schema), 9).collect())) == [(1, 1, 1, 1, 3, True, False, False), (2, 1, 2, 1, 10, False, True, True)]


def _calculation(**changed):
    operands = [{"name": "a", "receipt_id": "r1", "quote": "Revenue in 2020: 1,234.50", "metric": "revenue", "period": "2020", "value": "1234.5", "unit": "USD", "scale": "million"}, {"name": "b", "receipt_id": "r2", "quote": "Costs in 2020: (34.5)", "metric": "Costs", "period": "2020", "value": "-34.5", "unit": "USD", "scale": "million"}]
    operands[0] |= {k: v for k, v in changed.items() if k != "expression"}
    return ("e", "c1", 3, changed.get("expression", "(a + b) / 2"), operands)


OPERANDS = "array<struct<name:string,receipt_id:string,quote:string,metric:string,period:string,value:string,unit:string,scale:string>>"
RECEIPTS = [("e", "r1", "d", 1, "read", "x Revenue in 2020: 1,234.50 y", 1), ("e", "r2", "d", 2, "grep_document", "Costs in 2020: (34.5)", 2), ("e", "r3", "d", 1, "bm25_search", "x Revenue in 2020: 1,234.50 y", 1), ("e", "r4", "d", 1, "read", "Revenue in 2020: 1,234.50", 3)]


def _frames(spark, *calculations):
    return spark.createDataFrame(list(calculations), f"episode_id string, calc_id string, turn int, expression string, operands {OPERANDS}"), spark.createDataFrame(RECEIPTS, "episode_id string, receipt_id string, document_id string, page int, tool string, text string, delivered_turn int")


@pytest.mark.parametrize("changed,error,valid", [
    ({}, None, True), ({"receipt_id": "r3"}, "not_delivered", False), ({"receipt_id": "r4"}, "not_delivered", False), ({"receipt_id": "r9"}, "not_delivered", False), ({"quote": "1,234.50 invented"}, "not_delivered", False), ({"quote": ""}, "not_delivered", False),
    ({"metric": "profit"}, "metric_or_period", False), ({"period": "2019"}, "metric_or_period", False), ({"value": "1234"}, "value_not_in_quote", False), ({"value": "x"}, "value", False), ({"unit": ""}, "unit_or_scale", False), ({"scale": "dozen"}, "unit_or_scale", False),
    ({"expression": "a + c"}, "expression", False), ({"expression": "a"}, "expression", False), ({"expression": "a % b"}, "expression", False), ({"expression": "a * b + " + "1 + " * 200 + "1"}, "too_large", False),
])
def test_operand_provenance(spark, changed, error, valid):
    (r,) = O.calculated(*_frames(spark, _calculation(**changed))).collect()
    assert (r["error"], r["provenance_valid"]) == (error, valid) and (r["value"] is None) == (error is not None)


def test_constants_are_no_provenance(spark):
    (r,) = O.calculated(*_frames(spark, ("e", "c1", 3, "1 + 1", []))).collect()
    assert (r["value"], r["error"], r["provenance_valid"]) == ("2", None, False)


def _grounded(spark, calculation, cited=("r1", "r2"), value="600", calc_id="c1", **target):
    made, receipts = _frames(spark, calculation)
    spans = [("d", 1, "Revenue in 2020: 1,234.50")], [("d", 2, "(34.5)")]
    wanted = target.get("operands", [("p", "1234.50", "$", "millions", "REVENUE", "2020", spans[0]), ("q", "-34.50", "usd", "m", "costs", "2020", spans[1])])
    span = "array<struct<document_id:string,page:int,quote:string>>"
    targets = spark.createDataFrame([("q", "USD", "million", 1, target.get("expression", "(p + q) / 2"), wanted)], f"question_id string, unit string, scale string, precision int, expression string, operands array<struct<name:string,value:string,unit:string,scale:string,metric:string,period:string,support:{span}>>")
    submissions = spark.createDataFrame([("e", "q", calc_id, target.get("turn", 5), value, "USD", "million")], "episode_id string, question_id string, calc_id string, turn int, value string, unit string, scale string")
    visible = spark.createDataFrame([("e", r) for r in cited], "episode_id string, receipt_id string")
    return O.grounded(submissions, targets, O.calculated(made, receipts), visible, receipts).first()["derivation_grounded"]


def test_derived_answers_need_the_reviewed_derivation(spark):
    swapped = [("p", "-34.5", "USD", "m", "costs", "2020", [("d", 2, "(34.5)")]), ("q", "1234.5", "USD", "m", "revenue", "2020", [("d", 1, "1,234.50")])]
    assert _grounded(spark, _calculation())
    assert not _grounded(spark, _calculation(), cited=("r1",)) and not _grounded(spark, _calculation(), value="601") and not _grounded(spark, _calculation(), calc_id="c2") and not _grounded(spark, _calculation(), turn=3)
    assert not _grounded(spark, _calculation(), expression="(p + q) / 3") and not _grounded(spark, _calculation(expression="600 + a - a + b - b")) and not _grounded(spark, _calculation(metric="profit"))
    assert not _grounded(spark, _calculation(), operands=swapped) and _grounded(spark, _calculation(), operands=swapped, expression="(q + p) / 2")
    assert not _grounded(spark, _calculation(), operands=[("p", "1234.5", "USD", "m", "revenue", "2020", [("d", 7, "1,234.50")]), ("q", "-34.5", "USD", "m", "costs", "2020", [("d", 2, "(34.5)")])])


def test_typed_score_is_total(spark):
    span = "array<struct<document_id:string,page:int,quote:string,claim:string>>"
    submissions = spark.createDataFrame([("e1", "q1", "numeric", "5", "USD", "ones", None, ""), ("e2", "q2", "numeric", "5", "USD", "ones", None, ""), ("e3", "q3", "numeric", "5", "USD", "ones", None, "")], "episode_id string, question_id string, answer_type string, value string, unit string, scale string, decision string, answer_text string")
    targets = spark.createDataFrame([("q1", "numeric", "5", "$", "ones", 0, None, [], [("d", 1, "five", None)], "resolved", True), ("q2", "numeric", "5", "$", "ones", 0, None, [], [("d", 1, "five", None)], "resolved", False)],
                                    f"question_id string, answer_type string, value string, unit string, scale string, precision int, decision string, aliases array<string>, supports {span}, adjudication_status string, derived boolean")
    receipts = spark.createDataFrame([(e, "r1", "d", 1, "read", "five", 0) for e in ("e1", "e2", "e3")], "episode_id string, receipt_id string, document_id string, page int, tool string, text string, delivered_turn int")
    citations = spark.createDataFrame([(e, "r1", "d", 1, 1) for e in ("e1", "e2")], "episode_id string, receipt_id string, document_id string, page int, turn int")
    with pytest.raises(Exception, match="no target for q3"):
        S.typed_score(submissions, targets, citations, receipts).collect()
    for derivations, g in ((None, 0.0), (True, 1.0), (False, 0.0)):
        frame = None if derivations is None else spark.createDataFrame([("e1", derivations)], "episode_id string, derivation_grounded boolean")
        got = {r["episode_id"]: r for r in S.typed_score(submissions, targets, citations, receipts, strict=False, derivations=frame).collect()}
        assert (got["e1"]["A"], got["e1"]["G"], got["e2"]["G"]) == (1.0, g, 1.0) and got["e1"]["reward"] == 0.5 + 0.5 * g
        assert got["e3"]["target_missing"] and got["e3"]["A"] is None and got["e3"]["reward"] is None and not got["e1"]["target_missing"]


def test_context_policies(spark):
    turns = [(0, "system", 5), (1, "user", 10), (2, "assistant", 20), (3, "tool", 30), (4, "assistant", 20), (5, "assistant", 7), (6, "tool", 9)]
    x = spark.createDataFrame([("a", *t) for t in turns], "conv string, turn int, role string, size int")
    left = lambda budget: [r["turn"] for r in V.evicted_pairs(x, "conv", "turn", "size", budget).orderBy("turn").collect()]
    assert left(101) == [0, 1, 2, 3, 4, 5, 6] and left(100) == left(51) == [0, 1, 4, 5, 6] and left(50) == [0, 1, 5, 6] and left(30) == [0, 1]
    assert [r["refused"] for r in V.context_status(x, "conv", "size", 10, 110).collect()] == [True] and [r["refused"] for r in V.context_status(x, "conv", "size", 10, 111).collect()] == [False]


def test_repairs_and_gates(spark):
    e = "array<struct<name:string,arguments:string>>"
    x = spark.createDataFrame([(1, [("read", "1"), ("finish", "2")], [("read", "3")], 0, True, 1.0), (2, [("read", "1")], [], 0, True, 1.0), (3, [("finish", "2")], [], 2, True, 1.0), (4, [("finish", "2")], [], 0, False, 1.0), (5, [("finish", "2")], [], 0, True, 0.0)], f"id int, events {e}, reads {e}, parse int, ok boolean, g double")
    good, bad = X.replayed_repairs(x, "events", "reads", F.col("parse"), F.col("ok"), F.lit(1), F.lit(1), F.col("g"))
    assert [[v["arguments"] for v in r["events"]] for r in good.collect()] == [["1", "3", "2"]] and {r["id"]: r["repair_status"] for r in bad.collect()} == {2: "finish_count", 3: "parse_error", 4: "unreadable_support", 5: "score"}
    one, other = (spark.createDataFrame([(m, "v")], "judge string, version string") for m in ("a", "b"))
    assert [X.resume_gate(one, s, n) for s, n in ((None, 0), (None, 3), (one, 3), (other, 3), (one.drop("judge"), 3))] == ["start", "unidentified", "resume", "differs", "differs"]
    assert X.exactly(spark.range(12), "id", 12).count() == 12
    for rows in (spark.range(11), spark.range(12).union(spark.range(1)).where("id <> 3")):
        with pytest.raises(ValueError):
            X.exactly(rows, "id", 12)
    assert X.resolved_targets(spark.createDataFrame([(1, None), (2, "resolved"), (3, "unresolved")], "id int, adjudication_status string")).count() == 2
    none = spark.createDataFrame([], "v double")
    assert none.agg(X.mean_or_null(F.col("v")).alias("m")).first()["m"] is None and tuple(P.valid_summary(none, "v").first()) == (0, 0, 0, 0.0)
    found = spark.createDataFrame([("429 Too Many", "unresolved", 1.0), ("rate limit", None, 0.0), ("other", None, 1.0), (None, None, 1.0)], "m string, s string, f double")
    assert [(r["a"], r["b"]) for r in found.select(U.rate_limited(F.col("m")).alias("a"), S.replayed_status(F.col("f"), F.col("s")).alias("b")).collect()] == [(True, "target_unresolved"), (True, "no_submission"), (False, None), (False, None)]


def test_small_scores_and_validators(spark):
    x = spark.createDataFrame([("none", True), ("partial", True), ("full", True), ("full", False), ("odd", True)], "c string, k boolean")
    assert [r["v"] for r in x.select(S.coverage_value(F.col("c"), F.col("k")).alias("v")).collect()] == [0.0, 0.5, 1.0, 0.0, None]
    x = spark.createDataFrame([(True, 1.0, False), (True, 0.5, False), (True, 1.0, True), (None, 1.0, False)], "a boolean, q double, c boolean")
    assert [r["v"] for r in x.select(S.completeness_bonus(F.col("a"), F.col("q"), F.col("c")).alias("v")).collect()] == [1, 0, 0, 0]
    cite = "array<struct<receipt_id:string,document_id:string,page:int>>"
    subs = [(1, "numeric", "5", "USD", "ones", None, "", [("r1", "d", 1)]), (2, "numeric", "5", "", "ones", None, "so", []), (3, "boolean", None, None, None, "maybe", "", None), (4, "text", None, None, None, None, " ", [("", "d", 0)]), (5, "odd", None, None, None, None, "", [])]
    got = {r["id"]: set(r["violations"]) for r in Y.submission_violations(spark.createDataFrame(subs, f"id int, answer_type string, value string, unit string, scale string, decision string, answer_text string, citations {cite}"), "id").collect()}
    assert got == {2: {"number", "prose"}, 3: {"decision"}, 4: {"text", "citations"}, 5: {"answer_type"}}
    claims = "array<struct<id:string,expected:string>>"
    rubrics = [(1, "mixed", [("a", "1")], [("b", "x")]), (2, "numeric", [], []), (3, "semantic", [("a", "1")], [("b", "x")]), (4, "mixed", [("a", "1")], [("a", "x"), ("a", "")]), (5, "odd", [("a", "1")], [("b", "2")])]
    got = {r["id"]: set(r["violations"]) for r in Y.rubric_violations(spark.createDataFrame(rubrics, f"id int, mode string, numeric {claims}, semantic {claims}"), "id").collect()}
    assert got == {2: {"numeric"}, 3: {"numeric"}, 4: {"unique", "expected"}, 5: {"mode"}}
    pages = G.seeded_pages(spark, list("abcdefg"), 2, 3, seed=1).collect()
    assert sorted(r["key"] for r in pages) == list("abcdefg") and [r["page"] for r in sorted(pages, key=lambda r: r["position"])] == [0, 0, 0, 1, 1, 1, 2]
    assert Y.quote_window("Net sales rose. Net sales\n2020 5,000 end", "net sales", "2020", "5000") == "Net sales rose. Net sales\n2020 5,000 end" and Y.quote_window("nothing", "net sales", "2020", "5") is None


def test_many_terms_are_joined(spark, monkeypatch):
    items = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i, i + 5))) for i in range(30)], "id int, text string")
    q = spark.createDataFrame([(1, " ".join(f"w{j}" for j in range(20)))], "query_id int, query string")
    few = sorted(map(tuple, R.scores(R.index(items, ["id"]), q, ["id"]).collect()))
    monkeypatch.setattr(R, "TERMS_PUSHED", 3)
    assert few == sorted(map(tuple, R.scores(R.index(items, ["id"]), q, ["id"]).collect()))


@pytest.mark.parametrize("q", [0.0, 0.5, 0.95, 1.0])
def test_quantiles_of_hot_groups_are_exact(spark, q):
    import random

    rng = random.Random(q)
    groups = {"hot": [rng.expovariate(1) ** 3 for _ in range(30_000)], "ties": [float(rng.randrange(3)) for _ in range(5000)], "one": [7.0] * 4000, "few": [3.0, 1.0, 2.0], "single": [5.0], "signs": [rng.gauss(0, 1) for _ in range(2500)]}
    frame = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("few", None), ("none", None)], "g string, v double")
    got = {r["g"]: r["x"] for r in P.floor_quantile(frame, ["g"], "v", q, "x", most=100).collect()}
    assert got == {g: sorted(vs)[min(len(vs) - 1, int((len(vs) - 1) * q))] for g, vs in groups.items()}


def test_bootstrap_of_many_units_in_chunks(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    deltas = rng.normal(0.3, 1.0, 3000)
    pairs = spark.createDataFrame([("a", int(i), float(d)) for i, d in enumerate(deltas)] + [("b", 1, 2.0), ("b", 2, 2.0)], "run string, unit long, delta double")
    got = {r["run"]: r for r in P.bootstrap(pairs, "run", "unit", "delta", resamples=800, chunk=500, tasks=4).collect()}
    half = 1.96 * deltas.std() / np.sqrt(len(deltas))
    assert got["a"]["n_units"] == 3000 and abs(got["a"]["low"] - (deltas.mean() - half)) < 0.25 * half and abs(got["a"]["high"] - (deltas.mean() + half)) < 0.25 * half
    assert (got["b"]["low"], got["b"]["high"], got["b"]["delta"]) == (2.0, 2.0, 2.0)
    again = {r["run"]: r for r in P.bootstrap(pairs.repartition(7), "run", "unit", "delta", resamples=800, chunk=500, tasks=4).collect()}
    assert again["a"]["low"] == pytest.approx(got["a"]["low"], abs=1e-12)


def test_calculations_of_several_receipts_and_of_one(spark):
    """Operands of one receipt, of two, of none that is there, and receipts that came twice; the first operand's error counts, and no row is lost or doubled."""
    op = lambda n, r, quote="x in 2020: 5", value="5": (n, r, quote, "x", "2020", value, "USD", "m")
    kind = "episode_id string, calc_id string, turn int, expression string, operands array<struct<name:string,receipt_id:string,quote:string,metric:string,period:string,value:string,unit:string,scale:string>>"
    one, two = "a + 1", "a + b"
    made = [("e", "c1", 3, one, [op("a", "r1")]), ("e", "c2", 3, two, [op("a", "r1"), op("b", "r2")]), ("e", "c3", 3, two, [op("a", "r1"), op("b", "r9")]), ("e", "c4", 3, two, [op("a", "r1", value="6"), op("b", "r9")]), ("e", "c5", 1, one, [op("a", "r1")]),
            ("e", "c6", 3, one, [op("a", None)]), ("e", "c7", 3, one, None), ("e", "c8", 3, two, [op("a", "r1"), op("a", "r1")]), ("f", "c1", 3, one, [op("a", "r1")]), ("e", "c9", 3, two, [op("a", "r1", "x in 2020: 50", "50"), op("b", "r1", "x in 2020: (5)", "5")]), ("e", "c10", 3, one, [op("a", "r3")])]
    receipts = [("e", r, tool, "x in 2020: 5", 1) for r, tool in (("r1", "read"), ("r1", "read"), ("r2", "read"), ("r3", "bm25_search"))]
    out = O.calculated(spark.createDataFrame(made, kind), spark.createDataFrame(receipts, "episode_id string, receipt_id string, tool string, text string, delivered_turn int"))
    got = sorted((r["episode_id"], r["calc_id"], r["error"], r["value"], r["provenance_valid"]) for r in out.collect())
    late = "not_delivered"
    assert got == sorted([("e", "c1", None, "6", True), ("e", "c2", None, "10", True), ("e", "c3", late, None, False), ("e", "c4", "value_not_in_quote", None, False), ("e", "c5", late, None, False), ("e", "c6", late, None, False),
                          ("e", "c7", "expression", None, False), ("e", "c8", "expression", None, False), ("f", "c1", late, None, False), ("e", "c9", late, None, False), ("e", "c10", late, None, False)])


def test_texts_of_receipts_are_not_moved_twice(spark):
    """A derived answer is held against places alone: the receipts that it is given need no text."""
    made, receipts = _frames(spark, _calculation())
    span = "array<struct<document_id:string,page:int,quote:string>>"
    wanted = [("p", "1234.50", "$", "millions", "REVENUE", "2020", [("d", 1, "Revenue in 2020: 1,234.50")]), ("q", "-34.50", "usd", "m", "costs", "2020", [("d", 2, "(34.5)")])]
    targets = spark.createDataFrame([("q", "USD", "million", 1, "(p + q) / 2", wanted)], f"question_id string, unit string, scale string, precision int, expression string, operands array<struct<name:string,value:string,unit:string,scale:string,metric:string,period:string,support:{span}>>")
    submissions = spark.createDataFrame([("e", "q", "c1", 5, "600", "USD", "million")], "episode_id string, question_id string, calc_id string, turn int, value string, unit string, scale string")
    visible = spark.createDataFrame([("e", "r1"), ("e", "r2")], "episode_id string, receipt_id string")
    assert O.grounded(submissions, targets, O.calculated(made, receipts), visible, receipts.drop("text")).first()["derivation_grounded"]

"""The verdict source: every content is asked at most three times, stored once, and never again once answered."""

import hashlib
import uuid
from collections import Counter

import pytest

from veritrail.sources import verdicts as D

TEXTS = ["fine", "fine", "fine", "slow", "down", "no", "", None, "x" * 100_000, "é"]


def client(log):
    def judge(text, attempt):
        (log / f"{hashlib.md5(text.encode()).hexdigest()}-{attempt}-{uuid.uuid4().hex}").touch()
        if text == "no":
            raise D.Refused("never")
        if text == "down" or (text == "slow" and attempt < 3):
            raise ConnectionError("busy")
        return f"{len(text)}"

    return judge


def calls(log):
    named = {hashlib.md5(t.encode()).hexdigest(): t for t in TEXTS if t is not None}
    return Counter(named[f.name.split("-")[0]] for f in log.iterdir())


def result(frame):
    return sorted((r["i"], r["verdict"], r["attempts"], r["error"]) for r in frame.collect())


@pytest.fixture
def log(tmp_path):
    (tmp_path / "log").mkdir()
    return tmp_path / "log"


def test_attempts_and_store(spark, tmp_path, log):
    requests, store = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string"), str(tmp_path / "store")
    want = {"slow": ("4", 3, None), "down": (None, 3, "ConnectionError: busy"), "no": (None, 1, "Refused: never"), None: (None, None, None)}
    got = D.ask(requests, "text", client(log), store, "a", waits=(0, 0), per_task=2)
    assert result(got) == [(i, *want.get(t, (None if t is None else str(len(t)), 1, None))) for i, t in enumerate(TEXTS)]
    assert calls(log) == {"fine": 1, "slow": 3, "down": 3, "no": 1, "": 1, "x" * 100_000: 1, "é": 1}
    # Again: only what has no verdict is asked, what has one has taken no attempt.
    before, again = calls(log), D.ask(requests, "text", client(log), store, "a", waits=(0, 0))
    assert {r[2] for r in result(again) if r[1] is not None} == {0} and calls(log) - before == {"down": 3, "no": 1}
    kept = [r["content"] for r in D.stored(spark, store).collect()]
    assert len(kept) == len(set(kept)) == 5
    # Another judge's verdicts are its own.
    D.ask(requests.where("text = 'fine'"), "text", client(log), store, "b", waits=(0, 0))
    assert calls(log)["fine"] == 2


def test_two_runs_at_once_are_read_alike(spark, tmp_path):
    store = str(tmp_path / "s")
    for run, verdict in (("run-2", "late"), ("run-1", "early")):
        spark.createDataFrame([("k", 1, verdict, None, False)], D.STORED).write.parquet(f"{store}/{run}/round-1")
    assert [tuple(r) for r in D.stored(spark, store).collect()] == [("k", "early")]


def test_empty_and_clashing(spark, tmp_path, log):
    none = spark.createDataFrame([], "i int, text string")
    assert result(D.ask(none, "text", client(log), str(tmp_path / "s"), "a")) == [] and D.stored(spark, str(tmp_path / "s")).count() == 0
    with pytest.raises(ValueError, match="verdict"):
        D.ask(spark.createDataFrame([(1, "x")], "Verdict int, text string"), "text", client(log), str(tmp_path / "s"), "a")

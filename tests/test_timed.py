"""Episodes with timers: the stream, stopped and started again in its middle, equals the batch form and plain Python."""

import random
from datetime import UTC, datetime, timedelta

import pytest

from veritrail.streaming import timed

SCHEMA = "episode_id long, at timestamp, turn long, kind string, receipt string, us string"
START = datetime(2024, 1, 1, tzinfo=UTC)


def by_hand(rows, idle, max_turns):
    out = []
    for e in {r[0] for r in rows if r[0] is not None}:
        own = sorted([(r[1], r[2] or 0, r[3] or "", r[4]) for r in rows if r[0] == e and r[1] is not None], key=lambda r: r[:3])
        parts = []
        for r in own:
            if not parts or (r[0] - parts[-1][-1][0]).total_seconds() > idle:
                parts.append([])
            parts[-1].append(r)
        for p in parts:
            known, bad = {}, 0
            for _, turn, kind, receipt in p:
                if kind == "deliver" and receipt is not None:
                    known.setdefault(receipt, turn)
                elif kind == "cite":
                    bad += not (receipt is not None and receipt in known and known[receipt] < turn)
            n, us = sum(r[2] == "finish" for r in p), lambda t: round((t - datetime(1970, 1, 1, tzinfo=UTC)).total_seconds() * 1e6)
            turns = max(r[1] for r in p)
            out.append((e, us(p[0][0]), us(p[-1][0]), len(p), len(known), n, bad, turns, ["expired", "finished"][n] if n < 2 else "ambiguous", turns > max_turns))
    return sorted(out)


def made(seed, n=150):
    rng, rows, clock = random.Random(seed), [], 0
    for i in range(n):
        clock += rng.choice([1, 5, 20, 60])
        kind = rng.choice(["deliver", "deliver", "cite", "cite", "finish", "other", None])
        rows.append((rng.randrange(6), START + timedelta(seconds=clock, microseconds=rng.randrange(1000)), rng.choice([i, i, None]), kind, rng.choice(["a", "b", None]), "x"))
    return rows + [(None, START, 1, "finish", None, "x"), (3, None, 1, "finish", None, "x")] + rows[7:9]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_batch(spark, seed):
    rows = made(seed)
    got = timed.timed_batch(spark.createDataFrame(rows, SCHEMA), 90, 80)
    assert sorted(map(tuple, got.collect())) == by_hand(rows, 90, 80)


def test_batch_bounds(spark):
    at = lambda s: datetime(1969, 12, 31, 23, 59, tzinfo=UTC) + timedelta(seconds=s)  # noqa: E731  before the epoch, too
    rows = [(1, at(s), s, "finish", None, "") for s in (0, 10, 20, 31, 70, 80)]  # a gap equal to the budget goes on, a longer one does not
    assert [r["events"] for r in timed.timed_batch(spark.createDataFrame(rows, SCHEMA), 10, 99).orderBy("first_us").collect()] == [3, 1, 2]
    assert timed.timed_batch(spark.createDataFrame([], SCHEMA), 10, 99).count() == 0


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    for k, v in timed.STATE_STORE.items():
        spark.conf.set(k, v)
    rows, rng = made(4), random.Random(4)
    order = [r for r in rows if r[1] is not None]
    order.sort(key=lambda r: r[1] + timedelta(seconds=rng.randrange(30)))  # up to 30 seconds late
    end = (99, START + timedelta(days=2), 0, "finish", None, "x")

    def run(part):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = timed.timed_stream(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), 90, 80, "40 seconds")
        q = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
        assert q.awaitTermination(120)
        return spark.read.schema(timed.OUT).parquet(str(tmp_path / "out"))

    cut = len(order) // 2
    early = run(order[:cut]).count()
    assert 0 < early < len(by_hand(rows, 90, 80))  # what was over is out, what is open waits in the checkpoint
    run(order[cut:])
    got = run([end])
    assert sorted(map(tuple, got.collect())) == by_hand(rows, 90, 80)

"""Episodes with time budgets, as a stream with timers and as a batch that gives the same rows.

Events: episode_id, at (timestamp), turn, kind (deliver, cite, finish, other), receipt. An episode whose next event is more than ``idle_seconds`` after the last
one is over; later events of its id are a new episode with its own receipts. An episode is reported once, when it is over, with why: finished (one
finish), ambiguous (several), expired (none, so its time budget ran out).

The stream is a ``transformWithState``: events wait in state until the watermark has passed them, so they count in order of time (then turn) however they
arrive within the watermark's delay; then only sums and first deliveries are kept. One timer a key wakes at the next waiting event or at the end of
the time budget, where the state is deleted. It needs the RocksDB state store (``STATE_STORE``) and goes on from its checkpoint after a restart.

The batch form cuts time into slots as long as the budget: only slots, of which there are few, are looked at in order; events take their episode's number from
their slot by a join, so an episode id with most of the rows is never sorted in one task.

Events without an id or a time take no part; a null turn is turn 0; a null receipt delivers nothing and is no valid citation; repeated events count as often as
they occur; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

#: The setting that ``timed_stream`` needs.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
OUT = "episode_id long, first_us long, last_us long, events long, receipts long, finishes long, invalid_citations long, turns long, reason string, over_budget boolean"
REASONS = {0: "expired", 1: "finished"}


def _placed(events: DataFrame) -> DataFrame:
    known = events.where("episode_id IS NOT NULL AND at IS NOT NULL")
    return known.select(F.col("episode_id").cast("long").alias("episode_id"), "at", F.unix_micros("at").alias("us"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), "kind", "receipt")


class _Episode(StatefulProcessor):
    def __init__(self, idle_us: int, max_turns: int):
        self.idle, self.max_turns = idle_us, max_turns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "first long, last long, events long, finishes long, invalid long, turns long")
        self.known = handle.getMapState("known", "receipt string", "turn long")
        self.waiting = handle.getListState("waiting", "us long, turn long, kind string, receipt string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        self.waiting.appendList([(r["us"], r["turn"], r["kind"], r["receipt"]) for r in rows])
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs() * 1000)

    def _advance(self, key, watermark: int) -> Iterator[Row]:
        """Counts the events that the watermark has passed, reports what is over, and sets the timer anew."""
        waiting = list(self.waiting.get())
        due = sorted((w for w in waiting if w[0] <= watermark), key=lambda w: (w[0], w[1], w[2] or ""))
        for us, turn, kind, receipt in due:
            if self.sums.exists() and us - self.sums.get()[1] > self.idle:
                yield self._over(key)
            self._count(us, turn, kind, receipt)
        later = [w for w in waiting if w[0] > watermark]
        if due:
            self.waiting.put(later) if later else self.waiting.clear()
        if self.sums.exists() and self.sums.get()[1] + self.idle <= watermark:  # events to come are all after the watermark
            yield self._over(key)
        wake = min([w[0] for w in later] + ([self.sums.get()[1] + self.idle] if self.sums.exists() else []), default=None)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if wake is not None:
            self.handle.registerTimer(wake // 1000 + 1)

    def _count(self, us: int, turn: int, kind: str, receipt: str | None) -> None:
        first, _, events, finishes, invalid, turns = self.sums.get() if self.sums.exists() else (us, us, 0, 0, 0, turn)
        if kind == "deliver" and receipt is not None and not self.known.containsKey((receipt,)):
            self.known.updateValue((receipt,), (turn,))
        elif kind == "cite":  # a receipt can be used only after the turn that delivered it
            invalid += not (receipt is not None and self.known.containsKey((receipt,)) and self.known.getValue((receipt,))[0] < turn)
        self.sums.update((first, us, events + 1, finishes + (kind == "finish"), invalid, max(turns, turn)))

    def _over(self, key) -> Row:
        first, last, events, finishes, invalid, turns = self.sums.get()
        receipts = sum(1 for _ in self.known.keys())
        self.sums.clear()
        self.known.clear()
        return Row(episode_id=key[0], first_us=first, last_us=last, events=events, receipts=receipts, finishes=finishes, invalid_citations=invalid, turns=turns, reason=REASONS.get(finishes, "ambiguous"), over_budget=turns > self.max_turns)

    def close(self) -> None:
        pass


def timed_stream(events: DataFrame, idle_seconds: int, max_turns: int, delay: str) -> DataFrame:
    """One row an episode that is over, for a streaming table of events that come at most ``delay`` late (append mode)."""
    placed = _placed(events).withWatermark("at", delay)
    return placed.groupBy("episode_id").transformWithState(_Episode(idle_seconds * 1_000_000, max_turns), OUT, "Append", "EventTime")


def timed_batch(events: DataFrame, idle_seconds: int, max_turns: int) -> DataFrame:
    """The same rows for a finished table."""
    idle = idle_seconds * 1_000_000
    placed = _placed(events).drop("at").withColumn("slot", F.expr(f"us div {idle}L - CAST(us % {idle}L < 0 AS LONG)"))
    # Events of one slot are less than the budget apart, so an episode can end only between slots.
    slots = placed.groupBy("episode_id", "slot").agg(F.min("us").alias("lo"), F.max("us").alias("hi"))
    w = W.partitionBy("episode_id").orderBy("slot")
    number = F.sum(F.coalesce((F.col("lo") - F.col("before") > idle).cast("long"), F.lit(0))).over(w)
    slots = slots.withColumn("before", F.lag("hi").over(w)).withColumn("part", number)
    keys = ["episode_id", "part"]
    placed = placed.join(slots.select("episode_id", "slot", "part"), ["episode_id", "slot"])
    first = placed.where("kind = 'deliver' AND receipt IS NOT NULL").groupBy(*keys, "receipt").agg(F.min(F.struct("us", "turn")).alias("d"))
    usable = (F.col("d.us") <= F.col("us")) & (F.col("d.turn") < F.col("turn"))
    # Equal citations go together before they are joined, so one receipt that all cite is no hot key of the join.
    cites = placed.where("kind = 'cite'").groupBy(*keys, "receipt", "us", "turn").agg(F.count("*").alias("n")).join(first, [*keys, "receipt"], "left")
    bad = cites.groupBy(*keys).agg(F.sum(F.when(F.coalesce(usable, F.lit(False)), 0).otherwise(F.col("n"))).alias("invalid_citations"))
    receipts = first.groupBy(*keys).agg(F.count("*").alias("receipts"))
    sums = placed.groupBy(*keys).agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count("*").alias("events"), F.count_if(F.col("kind") == "finish").alias("finishes"), F.max("turn").alias("turns"))
    out = sums.join(receipts, keys, "left").join(bad, keys, "left").na.fill(0, ["receipts", "invalid_citations"])
    columns = [c.split()[0] for c in OUT.split(", ")]
    return out.withColumn("reason", reason(F.col("finishes"))).withColumn("over_budget", F.col("turns") > max_turns).select(*columns)


def reason(finishes: Column) -> Column:
    return F.when(finishes == 0, REASONS[0]).when(finishes == 1, REASONS[1]).otherwise("ambiguous")

"""Episodes as a stream of events: receipts by delivery order, turn budget, terminal ambiguity. The batch form gives the same rows.

Events: episode_id, turn, kind (deliver, cite, finish, other), receipt (what is delivered or cited). Within an episode they come in order of turn.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "receipts array<struct<receipt:string,turn:long>>, finishes long, invalid long, turns long"
OUT = "episode_id long, receipts long, finishes long, invalid_citations long, turns long, accepted boolean, ambiguous boolean, over_budget boolean"


def _step(state: tuple[dict[str, int], int, int, int], rows: pd.DataFrame) -> tuple[dict[str, int], int, int, int]:
    known, finishes, invalid, turns = state
    for turn, kind, receipt in rows.sort_values(["turn", "kind"])[["turn", "kind", "receipt"]].itertuples(index=False):
        turns = max(turns, int(turn))
        if kind == "deliver":
            known.setdefault(receipt, int(turn))
        elif kind == "cite":
            invalid += not known.get(receipt, turn) < turn  # a receipt can be used only after the turn that delivered it
        elif kind == "finish":
            finishes += 1
    return known, finishes, invalid, turns


def stream(events: DataFrame, max_turns: int) -> DataFrame:
    """The state of each episode after every trigger, for a streaming table of events (update mode)."""

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, finishes, invalid, turns = state.get if state.exists else ([], 0, 0, 0)
        known = {r[0]: r[1] for r in (tuple(x) if not isinstance(x, dict) else (x["receipt"], x["turn"]) for x in held)}
        current = (known, finishes, invalid, turns)
        for rows in batches:
            current = _step(current, rows)
        known, finishes, invalid, turns = current
        state.update(([{"receipt": k, "turn": v} for k, v in known.items()], finishes, invalid, turns))
        ok = finishes == 1
        yield pd.DataFrame([(key[0], len(known), finishes, invalid, turns, ok, finishes > 1, turns > max_turns)], columns=["episode_id", "receipts", "finishes", "invalid_citations", "turns", "accepted", "ambiguous", "over_budget"])

    return events.groupBy("episode_id").applyInPandasWithState(update, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def batch(events: DataFrame, max_turns: int) -> DataFrame:
    """The same rows for a finished table: no state, a receipt's first delivery is joined to its citations."""
    first = events.where("kind = 'deliver'").groupBy("episode_id", "receipt").agg(F.min("turn").alias("_d"))
    cites = events.where("kind = 'cite'").join(first, ["episode_id", "receipt"], "left")
    bad = cites.groupBy("episode_id").agg(F.sum((~F.coalesce(F.col("_d") < F.col("turn"), F.lit(False))).cast("long")).alias("invalid_citations"))
    n = first.groupBy("episode_id").agg(F.count("*").alias("receipts"))
    out = events.groupBy("episode_id").agg(F.sum((F.col("kind") == "finish").cast("long")).alias("finishes"), F.max("turn").alias("turns"))
    out = out.join(n, "episode_id", "left").join(bad, "episode_id", "left").na.fill(0, ["receipts", "invalid_citations"])
    return out.select("episode_id", "receipts", "finishes", "invalid_citations", "turns", (F.col("finishes") == 1).alias("accepted"), (F.col("finishes") > 1).alias("ambiguous"), (F.col("turns") > max_turns).alias("over_budget"))


def usable_receipts(deliveries: DataFrame, turns: DataFrame, episode: str = "episode_id") -> DataFrame:
    """Per episode and turn, how many receipts were delivered before it: a running count over the union of both tables."""
    both = deliveries.select(episode, F.col("delivered_turn").alias("turn"), F.lit(1).alias("_d")).unionByName(turns.select(episode, "turn", F.lit(0).alias("_d")))
    w = W.partitionBy(episode).orderBy("turn").rangeBetween(W.unboundedPreceding, -1)
    return both.withColumn("usable", F.coalesce(F.sum("_d").over(w), F.lit(0))).where("_d = 0").select(episode, "turn", "usable")

"""Batch forms of the streams over the driver's events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming import timed
from .record_queries import episode_events
from .registry import Tables, query

IDLE = 43_200


@query("st3_timed_episodes", f"""
WITH e AS (SELECT user_id AS episode_id, epoch_us(ts) AS us, event_id AS turn, CASE event_type WHEN 'click' THEN 'deliver' WHEN 'view' THEN 'cite' WHEN 'purchase' THEN 'finish' ELSE 'other' END AS kind, props AS receipt FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY episode_id ORDER BY us) > {IDLE}000000 THEN 1 ELSE 0 END AS new FROM e),
s AS (SELECT *, sum(new) OVER (PARTITION BY episode_id ORDER BY us) AS part FROM g),
d AS (SELECT episode_id, part, receipt, min(us) AS d_us, arg_min(turn, (us, turn)) AS d_turn FROM s WHERE kind = 'deliver' AND receipt IS NOT NULL GROUP BY ALL),
b AS (SELECT s.episode_id, s.part, count(*) FILTER (NOT coalesce(d_us <= us AND d_turn < turn, false)) AS bad FROM s LEFT JOIN d ON s.episode_id = d.episode_id AND s.part = d.part AND s.receipt = d.receipt WHERE kind = 'cite' GROUP BY ALL),
n AS (SELECT episode_id, part, count(*) AS receipts FROM d GROUP BY ALL),
a AS (SELECT episode_id, part, max(us) - min(us) AS span_us, count(*) AS events, count(*) FILTER (kind = 'finish') AS finishes, max(turn) AS turns FROM s GROUP BY ALL)
SELECT a.episode_id, span_us, events, coalesce(receipts, 0) AS receipts, finishes, coalesce(bad, 0) AS invalid_citations, turns, CASE finishes WHEN 0 THEN 'expired' WHEN 1 THEN 'finished' ELSE 'ambiguous' END AS reason, turns > 9000 AS over_budget
FROM a LEFT JOIN n ON a.episode_id = n.episode_id AND a.part = n.part LEFT JOIN b ON a.episode_id = b.episode_id AND a.part = b.part
""")
def _(t: Tables) -> DataFrame:
    """Episodes that end after twelve hours without an event."""
    out = timed.timed_batch(episode_events(t), IDLE, 9000)
    return out.withColumn("span_us", F.col("last_us") - F.col("first_us")).drop("first_us", "last_us")

"""Verdicts of a judge, asked for over a store that is addressed by content: what was answered is never asked again.

A request is known by the SHA-256 of its text and of the judge's name. Requests of equal content are one; those in the store take no call. The others are asked in
rounds, one attempt a round: a round's answers and failures are written before the next one takes what failed, so an attempt is one row that stays, and
a lost executor repeats only the calls of its unfinished tasks. A request has at most as many rounds as ``waits`` has entries and one more; before round i there is a wait
of ``waits[i - 1]`` seconds. A ``Refused`` request is not asked again.

Each round goes to a folder of its own in the store, by Spark's commit of whole jobs, so a task that ran twice leaves one file. Two runs at once may both ask for a
request; readers take the verdict of the folder whose name comes first, so all of them see the same one. Failures are kept as well, for the record; the next
run asks for them again.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import written

#: What a row of the store has.
STORED = "content string, attempt int, verdict string, error string, final boolean"
#: The waits of the frozen protocol, in seconds: three attempts.
WAITS = (1.0, 2.0)
#: Requests of a task: what is asked again if its executor is lost.
PER_TASK = 256


class Refused(Exception):
    """Raised by a client for a request that no further attempt can answer."""


def content_key(request: Column, judge: str) -> Column:
    return F.sha2(F.concat_ws("\x00", F.lit(judge), request), 256)


def stored(spark: SparkSession, store: str) -> DataFrame:
    """content and verdict of everything answered, one row a content."""
    try:
        rows = spark.read.schema(STORED).option("recursiveFileLookup", "true").parquet(store)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], STORED)
        return rows.select("content", "verdict")
    told = rows.where("verdict IS NOT NULL").select("content", "verdict", F.col("_metadata.file_path").alias("file"))
    return told.groupBy("content").agg(F.min_by("verdict", F.struct("file", "verdict")).alias("verdict"))


def _asked(client: Callable[[str, int], str], attempt: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for content, request in rows[["content", "request"]].itertuples(index=False):
                try:
                    out.append((content, attempt, str(client(request, attempt)), None, False))
                except Exception as e:  # whatever a client raises is that request's failure, not the task's
                    out.append((content, attempt, None, f"{type(e).__name__}: {e}", isinstance(e, Refused)))
            yield pd.DataFrame(out, columns=["content", "attempt", "verdict", "error", "final"])

    return ask


def ask(requests: DataFrame, request: str, client: Callable[[str, int], str], store: str, judge: str, waits: Sequence[float] = WAITS, per_task: int = PER_TASK) -> DataFrame:
    """requests with verdict, attempts (0: it was in the store, null: nothing to ask) and error (of the last attempt, null where there is a verdict).

    client(text, attempt) answers with a text or raises; it runs in the executors and must be picklable. Null requests are not asked and have no verdict. Rows stay as they
    are: repeated ones all get the one verdict. Columns of requests named verdict, attempts or error are refused.
    """
    if clash := {"verdict", "attempts", "error"} & {c.lower() for c in requests.columns}:
        raise ValueError(f"requests have columns of the result: {sorted(clash)}")
    spark, run = requests.sparkSession, f"{store.rstrip('/')}/run-{time.time_ns():020d}-{uuid.uuid4().hex}"
    keyed = requests.withColumn("_content", F.when(F.col(request).isNotNull(), content_key(F.col(request), judge)))
    known = stored(spark, store)
    distinct = keyed.where("_content IS NOT NULL").groupBy(F.col("_content").alias("content")).agg(F.first(request).alias("request"))
    # What is open is written, so that a later round is of the same requests, whatever the store has become.
    left = written(distinct.join(known.select("content"), "content", "left_anti"), "asked")
    rounds = None
    for attempt in range(1, len(waits) + 2):
        n = left.count()
        if not n:
            break
        if attempt > 1:
            time.sleep(waits[attempt - 2])
        folder = f"{run}/round-{attempt}"
        left.repartition(-(-n // per_task), "content").mapInPandas(_asked(client, attempt), STORED).write.parquet(folder)
        told = spark.read.schema(STORED).parquet(folder)
        rounds = told if rounds is None else rounds.unionByName(told)
        left = left.join(told.where("verdict IS NULL AND NOT final").select("content"), "content", "left_semi")
    rounds = rounds if rounds is not None else spark.createDataFrame([], STORED)
    last = rounds.groupBy(F.col("content").alias("_content")).agg(F.max("attempt").alias("_n"), F.max_by("error", "attempt").alias("_error"))
    answers = stored(spark, store).select(F.col("content").alias("_content"), "verdict")
    # The answers of this run's requests only, so rows join what they asked for, not the whole store twice.
    out = keyed.join(answers.join(distinct.select(F.col("content").alias("_content")), "_content", "left_semi"), "_content", "left").join(last, "_content", "left")
    out = out.withColumn("attempts", F.when(F.col("_content").isNotNull(), F.coalesce("_n", F.lit(0)))).withColumn("error", F.when(F.col("verdict").isNull(), F.col("_error")))
    return out.drop("_content", "_n", "_error")

"""Writers. Spark's commit protocol makes each of them whole or absent."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.reporting import markdown
from .readers import manifest


def jsonl(frame: DataFrame, path: str, resume_key: str | None = None) -> None:
    """JSON lines. With a resume key, rows whose key is there already are left out and the rest is appended."""
    if resume_key:
        spark = frame.sparkSession
        try:
            have = spark.read.schema(frame.schema).json(path)
            frame = frame.join(have.select(resume_key).distinct(), resume_key, "left_anti")
        except Exception as e:  # nothing to resume from
            if "PATH_NOT_FOUND" not in str(e):
                raise
    frame.write.mode("append" if resume_key else "errorifexists").json(path)


def report(frame: DataFrame, path: str) -> None:
    """A small table as CSV and as Markdown, in path/csv and path/md; null is empty in the one and 'unmeasured' in the other."""
    frame.coalesce(1).write.option("header", True).mode("overwrite").csv(f"{path}/csv")
    lines = frame.sparkSession.createDataFrame([(i, x) for i, x in enumerate(markdown(frame))], "i int, value string")
    lines.coalesce(1).sortWithinPartitions("i").select("value").write.mode("overwrite").text(f"{path}/md")


def with_checksums(frame: DataFrame, path: str) -> DataFrame:
    """Writes the table as Parquet and returns the manifest of its files."""
    frame.write.mode("errorifexists").parquet(path)
    return manifest(frame.sparkSession, path).where(~F.col("path").contains("/_"))


def html_pairs(frame: DataFrame, columns: list[str]) -> str:
    """A page of a small comparison, everything escaped."""
    rows = "".join("<tr>" + "".join(f"<td>{html.escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in frame.select(*columns).toLocalIterator())
    return f"<table><tr>{''.join(f'<th>{html.escape(c)}</th>' for c in columns)}</tr>{rows}</table>"

"""What the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts' word pattern has it.
WS = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"

_own: dict[str, str] = {}
#: Paths of the tables written, by application.
_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. In local mode, where it may be unset, a folder of our own."""
    if given := spark.conf.get("spark.checkpoint.dir", None):
        return given
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="veritrail-")
    return _own[app]


def materialize(df: DataFrame, tag: str, *by: str, **options: object) -> DataFrame:
    """df written once to the shared folder and read back: lineage is cut, and lost executors lose nothing.

    by: columns whose values get folders of their own, so that a filter on them reads no others. The files stay, as lazy results read them,
    until ``release`` or the end of ``scratch``. options: of the writer.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/veritrail-{tag}-{uuid.uuid4().hex}"
    df.write.options(**options).partitionBy(*by).parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, keep: int = 0) -> int:
    """Deletes the intermediate tables of this application but the first ``keep``; how many. Results not written yet can't be read afterwards."""
    paths = _written.get(spark.sparkContext.applicationId, [])
    gone, paths[keep:] = paths[keep:], []
    for p in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(gone)


def discard(table: DataFrame) -> None:
    """Deletes a table that ``materialize`` gave, before the others; what was made of it must be written by now."""
    paths = _written.get(table.sparkSession.sparkContext.applicationId, [])
    files = table.inputFiles()
    for p in [p for p in paths if files and f"/{p.rpartition('/')[2]}/" in files[0]]:
        paths.remove(p)
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables of operators called within are deleted at the end; write results before that."""
    before = len(_written.get(spark.sparkContext.applicationId, []))
    try:
        yield
    finally:
        release(spark, before)


#: Rows and bytes that an operator takes from an Arrow batch at a time; Spark bounds the batches themselves by 64 MB.
SLICE_ROWS, SLICE_BYTES = 256, 4 << 20


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most so many rows and, beyond one row, bytes."""
    for b in batches:
        at = 0
        while at < b.num_rows:
            n = min(rows, b.num_rows - at)
            while n > 1 and b.slice(at, n).nbytes > size:
                n //= 2
            yield b.slice(at, n)
            at += n


#: Bytes up to which a written table is broadcast.
BROADCAST_BYTES = 16 << 20


def is_small(frame: DataFrame, size: Column) -> bool:
    """Whether the sizes of a written table's rows sum to few enough bytes for a broadcast."""
    return (frame.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES


def if_small(frame: DataFrame, size: Column) -> DataFrame:
    """A written table, marked for broadcast if it is small."""
    return F.broadcast(frame) if is_small(frame, size) else frame


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value, body):
    """body(value) with value computed once: Catalyst would otherwise copy the expression to every place that uses it."""
    return F.transform(F.array(value), body)[0]

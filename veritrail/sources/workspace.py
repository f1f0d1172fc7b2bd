"""Tables that are built once and read again: a folder that driver and executors share, and tables in segments that are known by the files they come from.

Input files are dealt to segments by a hash of their paths. A segment's state is a digest of its files' paths, sizes and times of change; segments of a
new state are built, all others are taken as they are. What is compared are rows of segments, so nothing of the size of the input goes to the
driver, and it is executors that read the files' metadata.

Everything is written to folders of its own first, and a catalog that names them comes last: a build that broke off is never read, and two
builds at once don't mix. What is built is known by its analyzed plan without expression numbers, so another text column, filter or
expression has tables of its own. Rows that come from no file have no state; they are built anew each time.
"""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

SEGMENTS = 64

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode, where it may be unset, a folder of this application's own."""
    if given := spark.conf.get("spark.checkpoint.dir", None):
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="veritrail-tables-")
    return _own[app]


def written(frame: DataFrame, name: str) -> DataFrame:
    """The frame written once to the shared folder and read back: what reads it several times computes it no more, and lost executors lose nothing."""
    path = f"{shared_dir(frame.sparkSession)}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def plan_digest(frame: DataFrame, *settings: str) -> str:
    """Of how a frame is computed: its analyzed plan without numbers of expressions and lambda variables, and settings. Python functions count by name."""
    plan = frame._jdf.queryExecution().analyzed().treeString(True, False, 1 << 20, False, False)
    plan = re.sub(r"#\d+L?", "#", re.sub(r"lambda (\w+?)_\d+#\d+", r"lambda \1", plan))
    plan = re.sub(r"plan_id=\d+", "plan_id", plan)
    return hashlib.sha256("\x00".join([plan, frame.schema.json(), *settings]).encode()).hexdigest()[:24]


def segment_of(path: Column, segments: int) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(segments)).cast("int")


def file_states(source: DataFrame, segments: int = SEGMENTS) -> DataFrame | None:
    """segment and state of the files that a frame is read from; None if it does not come from files alone."""
    m = F.col("_metadata")
    try:
        files = source.select(m["file_path"].alias("path"), m["file_size"].alias("size"), m["file_modification_time"].alias("changed")).distinct()
    except AnalysisException:
        return None
    digests = [F.hex(F.bit_xor(F.xxhash64(F.lit(seed), "path", "size", "changed"))) for seed in (1, 2)]
    return files.groupBy(segment_of(F.col("path"), segments).alias("segment")).agg(F.concat_ws("-", *digests, F.count("*")).alias("state"))


def _complete(spark: SparkSession, pattern: str) -> list[str]:
    """Folders of finished writes that fit the pattern."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{pattern}/_SUCCESS")
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return sorted(str(s.getPath().getParent().toString()) for s in found or [])


def segmented(source: DataFrame, root: str, build: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame], None], summarize: Callable[[dict[int, str], str], None] | None = None, segments: int = SEGMENTS) -> tuple[dict[int, str], str]:
    """The build of each segment in use, and the name of the summary over all of them.

    build makes rows of the source's rows, each by itself; write appends them, with build and segment, to tables under root that are partitioned by these two;
    summarize writes what is known of all segments together to a folder of its own.
    """
    spark, this = source.sparkSession, uuid.uuid4().hex
    states = file_states(source, segments)
    now = {r["segment"]: r["state"] for r in states.collect()} if states is not None else {0: this}  # at most ``segments`` rows
    whole = hashlib.sha256(repr(sorted(now.items())).encode()).hexdigest()[:24]
    found = _complete(spark, f"{root}/catalog-{whole}-*")
    if not found:
        known = {(r["segment"], r["state"]): r["build"] for c in _complete(spark, f"{root}/catalog-*") for r in spark.read.parquet(c).collect()}
        new = sorted(k for k, s in now.items() if (k, s) not in known)
        # The condition is on files alone, so those of other segments are not read.
        of = lambda k: source.where(segment_of(F.col("_metadata.file_path"), segments) == k)
        named = lambda rows, k: build(rows).withColumns({"build": F.lit(this), "segment": F.lit(k)})
        if new or not now:
            write(reduce(DataFrame.unionByName, [named(of(k), k) for k in new]) if now and states is not None else named(source, 0))
        used = {k: known.get((k, s), this) for k, s in now.items()}
        if summarize:
            summarize(used, f"{root}/summary-{this}")
        found = [f"{root}/catalog-{whole}-{this}"]
        rows = spark.createDataFrame([(k, s, used[k]) for k, s in now.items()], "segment int, state string, build string")
        rows.coalesce(1).write.parquet(found[0])
    rows = spark.read.schema("segment int, state string, build string").parquet(found[0]).collect()
    return {r["segment"]: r["build"] for r in rows}, f"{root}/summary-{found[0].rpartition('-')[2]}"


def read_segments(spark: SparkSession, root: str, name: str, used: dict[int, str], schema: Ty.StructType | str) -> DataFrame:
    """A table's rows of the segments in use, with segment."""
    schema = Ty._parse_datatype_string(schema) if isinstance(schema, str) else schema
    whole = Ty.StructType([*schema.fields, Ty.StructField("build", Ty.StringType()), Ty.StructField("segment", Ty.IntegerType())])
    wanted = [f"{b}/{k}" for k, b in used.items()]
    return spark.read.schema(whole).parquet(f"{root}/{name}").where(F.concat_ws("/", "build", "segment").isin(wanted)).drop("build")


def append(rows: DataFrame, root: str, name: str) -> None:
    rows.write.partitionBy("build", "segment").mode("append").parquet(f"{root}/{name}")


def load_pages(source: DataFrame, build: Callable[[DataFrame], DataFrame], strict: bool = False) -> DataFrame:
    """The pages that build() reads from the source's files, kept by the files' states, the strict flag and how they are built."""
    spark, pages = source.sparkSession, build(source)
    root = f"{shared_dir(spark)}/pages-{plan_digest(pages, '3', str(strict))}"
    used, _ = segmented(source, root, build, lambda rows: append(rows, root, "pages"))
    return read_segments(spark, root, "pages", used, pages.schema).drop("segment")

"""A written index of three-character sequences, and what of them a pattern requires: pages that can't match are ruled out before their lines are split.

A pattern's required text is read from its parsed form: literal runs, of which all are needed in a sequence and one of several in an alternation;
what may be absent, and classes of characters, require nothing. Runs shorter than three characters require nothing either, and a pattern without any
leaves all pages. Case is folded for A to Z on both sides, as patterns ignore case there. A page that is kept need not match: grep decides.

The index has one row for each sequence of a block of pages that lie together, with the keys of the pages that hold it. A task makes the blocks of what it
reads, so neither texts nor their sequences are shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.workspace import SEGMENTS, append, plan_digest, read_segments, segmented, shared_dir, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(UPPER, LOWER)
#: Characters of a text that are taken at once, and sequences after which a block of pages is full.
TAKEN, HELD = 1 << 20, 1 << 20

#: What a pattern requires: ("all" or "any", parts), or a text; None: nothing.
Need = tuple[str, list] | str | None


def _together(kind: str, parts: list[Need]) -> Need:
    if kind == "any" and any(p is None for p in parts):
        return None
    parts = [p for p in parts if p is not None]
    return None if not parts else parts[0] if len(parts) == 1 else (kind, parts)


def _required(tree) -> Need:
    parts, run = [], ""

    def end() -> None:
        nonlocal run
        if len(run) >= 3:
            parts.append(run)
        run = ""

    for op, value in tree:
        if op is C.LITERAL:
            # Of letters beyond ASCII, a pattern that ignores case may match others.
            run = run + chr(value).translate(_FOLD) if value < 128 else end() or ""
            continue
        if op is C.AT:
            continue
        end()
        if op is C.SUBPATTERN:
            parts.append(_required(value[3]) if not value[1] and not value[2] else None)
        elif op is C.BRANCH:
            parts.append(_together("any", [_required(b) for b in value[1]]))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and value[0] > 0:
            parts.append(_required(value[2]))
        elif op is C.ATOMIC_GROUP:
            parts.append(_required(value))
    end()
    return _together("all", parts)


def required(patterns: list[str]) -> Need:
    """What a line must hold for any of the patterns to match; one that does not compile makes all of them plain texts."""
    patterns = [p for p in patterns if p]
    try:
        needs = [_required(_parser.parse(p)) for p in patterns]
    except re.error:
        needs = [p.translate(_FOLD) if len(p) >= 3 and p.isascii() else None for p in patterns]
    return _together("any", needs) if needs else None


def grams_of(text: str) -> list[str]:
    return sorted({text[i : i + 3] for i in range(len(text) - 2)})


def grams(text: Column) -> Column:
    """The distinct three-character sequences of a text, A to Z folded."""
    chars = F.split(F.translate(text, UPPER, LOWER), "")
    return F.transform(F.array(chars), lambda c: F.array_distinct(F.array_compact(F.transform(F.sequence(F.lit(1), F.greatest(F.size(c) - 2, F.lit(1))), lambda i: F.concat(F.get(c, i - 1), F.get(c, i), F.get(c, i + 1))))))[0]


def _needed(need: Need) -> set[str]:
    return set() if need is None else set(grams_of(need)) if isinstance(need, str) else set().union(*map(_needed, need[1]))


def _holds(need: Need, have: Column) -> Column:
    if isinstance(need, str):
        wanted = grams_of(need)
        return F.size(F.array_intersect(have, F.array(*map(F.lit, wanted)))) == len(wanted)
    return reduce((lambda a, b: a & b) if need[0] == "all" else (lambda a, b: a | b), [_holds(p, have) for p in need[1]])


def _codes(text: str) -> np.ndarray:
    """The distinct three-character sequences of a text, A to Z folded, as numbers of three times 21 bits, in order."""
    found = np.zeros(0, np.int64)
    for i in range(0, len(text) - 2, TAKEN):
        c = np.frombuffer(text[i : i + TAKEN + 2].encode("utf-32-le"), "<u4").astype(np.int64)
        c += 32 * ((c >= ord("A")) & (c <= ord("Z")))
        found = np.union1d(found, c[:-2] << 42 | c[1:-1] << 21 | c[2:])
    return found


def _texts(codes: np.ndarray) -> list[str]:
    whole = np.stack([codes >> 42, codes >> 21 & 0x1FFFFF, codes & 0x1FFFFF], 1).astype("<u4").tobytes().decode("utf-32-le")
    return [whole[i : i + 3] for i in range(0, len(whole), 3)]


def _listed(rows: DataFrame, keys: list[str], text: str, held: int = HELD) -> DataFrame:
    """build, segment, gram, and of each key a list: those of a block's pages that hold it, in the order of the pages."""
    given = Ty.StructType([rows.schema["build"], rows.schema["segment"], Ty.StructField("gram", Ty.StringType()), *(Ty.StructField(k, Ty.ArrayType(rows.schema[k].dataType)) for k in keys)])
    schema = to_arrow_schema(given)

    def block(place: tuple, pages: list[pa.RecordBatch], codes: list[np.ndarray]) -> pa.RecordBatch:
        page, every = np.repeat(np.arange(len(codes)), list(map(len, codes))), np.concatenate(codes)
        by = np.argsort(every, kind="stable")
        page, every = pa.array(page[by]), every[by]
        first = np.flatnonzero(np.r_[len(every) > 0, every[1:] != every[:-1]])
        ends = pa.array(np.append(first, len(every)).astype(np.int32))
        of_pages = pa.Table.from_batches(pages).combine_chunks()
        lists = [pa.ListArray.from_arrays(ends, of_pages.column(k).combine_chunks().take(page).cast(schema.field(k).type.value_type), type=schema.field(k).type) for k in keys]
        same = [pa.array([v] * len(first), f.type) for v, f in zip(place, list(schema)[:2], strict=True)]
        return pa.RecordBatch.from_arrays([*same, pa.array(_texts(every[first]), pa.string()), *lists], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, pages, codes, size = None, [], [], 0
        for b in batches:
            of_keys, low = b.select(keys), 0
            places = list(zip(b.column("build").to_pylist(), b.column("segment").to_pylist(), strict=True))
            for i, t in enumerate(b.column(b.num_columns - 1).cast(pa.binary())):
                if codes and (size >= held or places[i] != place):
                    yield block(place, [*pages, of_keys.slice(low, i - low)], codes)
                    pages, codes, size, low = [], [], 0, i
                place = places[i]
                codes.append(_codes(t.as_py().decode("utf-8", "replace")))
                size += len(codes[-1])
            pages.append(of_keys.slice(low))
        if codes:
            yield block(place, pages, codes)

    return rows.select("build", "segment", *keys, text).mapInArrow(run, given)


def written_grams(source: DataFrame, name: str, build: Callable[[DataFrame], DataFrame], keys: list[str], text: str = "text", segments: int = SEGMENTS) -> DataFrame:
    """gram, and lists of the keys of the pages that build() makes of the source's rows and that hold it; only segments with new or changed files are built."""
    spark, pages = source.sparkSession, build(source)
    root = f"{shared_dir(spark)}/grams-{name}-{plan_digest(pages, '2', text, *keys, str(segments))}"

    def write(rows: DataFrame) -> None:
        # In order of grams within a task, so that a search skips most of what it wrote.
        append(_listed(rows.where(F.length(text) > 2), keys, text).sortWithinPartitions("build", "segment", "gram"), root, "grams")

    used, _ = segmented(source, root, build, write, segments=segments)
    schema = Ty.StructType([Ty.StructField("gram", Ty.StringType()), *(Ty.StructField(k, Ty.ArrayType(pages.schema[k].dataType)) for k in keys)])
    return read_segments(spark, root, "grams", used, schema).drop("segment")


def candidates(index: DataFrame, keys: list[str], patterns: list[str]) -> DataFrame | None:
    """Keys of the pages that can match; None if the patterns require nothing. Only grams of the patterns are read.

    They are written, so that Spark knows how few they are: a join with them need not shuffle the pages' texts.
    """
    need = required(patterns)
    if need is None:
        return None
    hits = index.where(F.col("gram").isin(sorted(_needed(need)))).select("gram", F.explode(F.arrays_zip(*keys)).alias("_page"))
    hits = hits.groupBy(*[F.col("_page")[k].alias(k) for k in keys]).agg(F.collect_set("gram").alias("_have"))  # no more than the patterns have
    return written(hits.where(_holds(need, F.col("_have"))).select(*keys), "candidates")

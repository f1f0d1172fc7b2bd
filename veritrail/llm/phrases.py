"""Phrase collocations by vertical positional inverted lists.

Documents are dealt into blocks of bounded size by the partitions they lie in; every word of a block takes a position, and every end of a piece
or document one more. An inverted list is the positions of a word or phrase in a block; the lengths of its lists, summed over all blocks,
are its exact frequency. Lists of frequent words are extended: in each block, the positions of frequent phrases of k words are merge-joined with
those of the frequent phrases one place on, which gives the lists of phrases of k + 1 words; those that are frequent over all blocks go on. A phrase
is known by the number of its first words and that of its last one, both given to frequent ones only, so counting compares numbers and is exact.

A block's lists are one row. They are extended twice, first for the lengths of the new lists, then for the lists of those phrases that turned out frequent; so
no list of any other phrase is written, and only lengths are shuffled: each block sends those of a part of all phrases as one row, and a part's are summed in one
task. Parts are by a hash of the phrase and more for larger tables, so neither a very frequent phrase nor a language with most of the rows makes a large one.
Frequent phrases are broadcast to the blocks up to a checked number of bytes; beyond it, those of each block are joined to it.

Words are lower-cased in A-Z; pieces end at . , ; : ! ? and line ends; a null language is ``und``. Null, empty and blank texts have no
words. Repeated rows count each time. Very long texts are read whole; one longer than a block is a block of its own. Rows without a doc_id count, and
extra columns take no part. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import discard, is_small, materialize, slices

LEAST, LONGEST, SHOWN = 100, 5, 2000
#: Parts of a language's phrases that are ranked by themselves first.
PARTS = 64
#: Positions of a block beyond one document.
BLOCK = 1 << 21
#: Lengths of lists that a part gets at most, on average.
SUMMED = 1 << 20
#: A block's lists in a row are large, so few rows are held by a writer or reader at a time.
ROWS = {"parquet.block.size": 16 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}
LISTS = "block long, phrase array<int>, word array<int>, n array<int>, positions array<int>"
NAMES = ["block", "phrase", "word", "n", "positions"]
SCHEMA = pa.schema([("block", pa.int64()), *((c, pa.list_(pa.int32())) for c in NAMES[1:])])
#: Ends of pieces. Each is replaced by a full stop of its own, which no word holds.
ENDS = re.compile(rb"[.,;:!?\x0A-\x0D]")


def _lists(ids: np.ndarray, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each id once, in order; how many positions it has; and these, list by list, as they come."""
    by = np.argsort(ids, kind="stable")
    ids = ids[by]
    first = np.flatnonzero(np.r_[len(ids) > 0, ids[1:] != ids[:-1]])
    return ids[first], np.diff(np.append(first, len(ids))), positions[by]


def _row(values, kind: pa.DataType | None = None) -> pa.ListArray:
    """One row that holds all the values, as ints if no kind is given."""
    values = pa.array(values.astype(np.int32) if kind is None else values, kind)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _posted(block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        seen: dict[str, dict[bytes, int]] = {}
        words: list[tuple[str, bytes]] = []
        ids: list[np.ndarray] = []
        at = 0

        def out() -> pa.RecordBatch:
            every = np.concatenate(ids)
            place = np.flatnonzero(every >= 0)
            which, n, place = _lists(every[place], place)
            some = [words[i] for i in which.tolist()]
            name = pa.array([task << 32 | number])
            texts = pa.array([w for _, w in some], pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([name, _row([x for x, _ in some], pa.string()), _row(texts, pa.string()), _row(n), _row(place)], ["block", "lang", "word", "n", "positions"])

        for b in slices(batches):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                tokens = ENDS.sub(b" . ", (text or b"").lower()).split()
                if at and at + len(tokens) > block:
                    yield out()
                    number, at = number + 1, 0
                    for x in (seen, words, ids):
                        x.clear()
                known = seen.setdefault(lang, {b".": -1})
                for w in set(tokens).difference(known):
                    known[w] = len(words)
                    words.append((lang, w))
                ids.append(np.fromiter(map(known.__getitem__, tokens), np.int32, len(tokens)))
                ids.append(np.full(1, -1, np.int32))
                at += len(tokens) + 1
        if words:
            yield out()

    return posted


def postings(docs: DataFrame, text: str = "text", lang: str = "lang", block: int = BLOCK) -> DataFrame:
    """block, and in order of its words their lang, word, n and positions: n of these for each."""
    given = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").alias("text"))
    return given.mapInArrow(_posted(block), "block long, lang array<string>, word array<string>, n array<int>, positions array<int>")


def _picked(block: int, ids: np.ndarray, words: np.ndarray, n: np.ndarray, positions: np.ndarray) -> list[pa.Array]:
    """A row of LISTS: those lists whose number is not negative."""
    some, held = ids >= 0, np.repeat(ids >= 0, n)
    return [pa.array([block], pa.int64()), _row(ids[some]), _row(words[some]), _row(n[some]), _row(positions[held])]


def _known_words(row: dict, known: dict[tuple[str, str], int]) -> list[pa.Array]:
    ids = np.fromiter((known.get(x, -1) for x in zip(row["lang"].to_pylist(), row["word"].to_pylist(), strict=True)), np.int64, len(row["word"]))
    return _picked(row["block"], ids, ids, row["n"].to_numpy(), row["positions"].to_numpy())


def _longer(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lists of k + 1 words of a block from those of k words: phrase and last word in one number, n, positions."""
    n, place = row["n"].to_numpy(), row["positions"].to_numpy()
    by = np.argsort(place, kind="stable")
    phrase, word = (np.repeat(row[c].to_numpy(), n)[by].astype(np.int64) for c in ("phrase", "word"))
    place = place[by]
    # The merge join of the sorted positions with themselves, one place on; a position begins one phrase at most.
    met = np.flatnonzero(place[1:] == place[:-1] + 1)
    return _lists(phrase[met] << 32 | word[met + 1], place[met])


def _known_phrases(row: dict, known: tuple[np.ndarray, np.ndarray]) -> list[pa.Array]:
    pairs, n, place = _longer(row)
    keys, ids = known
    at = np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)
    return _picked(row["block"], np.where(keys[at] == pairs, ids[at], -1) if len(keys) else np.full(len(pairs), -1), pairs & 0xFFFFFFFF, n, place)


def _rows_of(table: pa.RecordBatch | pa.Table) -> Iterator[dict]:
    """Each row's block and lists, one after the other."""
    for b in [table] if isinstance(table, pa.RecordBatch) else table.to_batches():
        for i in range(b.num_rows):
            yield {c: b.column(c)[i].as_py() if c == "block" else b.column(c)[i].values for c in b.schema.names}


def _words_as_known(t: pa.Table) -> dict[tuple[str, str], int]:
    return dict(zip(zip(t.column("lang").to_pylist(), t.column("word").to_pylist(), strict=True), t.column("id").to_pylist(), strict=True))


def _phrases_as_known(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    left, word, ids = (t.column(c).to_numpy().astype(np.int64) for c in ("left", "word", "id"))
    by = np.argsort(keys := left << 32 | word)
    return keys[by], ids[by]


def _named(lists: DataFrame, frequent: DataFrame, size: Column, own: Callable[[], DataFrame], as_known: Callable, pick: Callable) -> DataFrame:
    """LISTS of what is frequent. own: block and the columns by which frequent ones are known, for each list that a block has."""
    if is_small(frequent, size):
        given = lists.sparkSession.sparkContext.broadcast(frequent.toArrow())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = as_known(given.value)
            for b in batches:
                for row in _rows_of(b):
                    yield pa.RecordBatch.from_arrays(pick(row, known), NAMES)

        return lists.mapInArrow(run, LISTS)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        known = as_known(right)
        return pa.Table.from_batches([pa.RecordBatch.from_arrays(pick(row, known), NAMES) for row in _rows_of(left)], SCHEMA)

    by = [c for c in frequent.columns if c != "id"]
    kept = own().join(frequent, by).withColumnRenamed("block", "owner").groupBy("owner")
    return lists.groupBy("block").cogroup(kept).applyInArrow(meet, LISTS)


def _lengths(parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each part of all longer phrases: those of a block that fall into it, and their lists' lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in _rows_of(b):
                pairs, n, _ = _longer(row)
                part = ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % parts
                by = np.argsort(part, kind="stable")
                which, ends = np.unique(part[by], return_index=True)
                ends = pa.array(np.append(ends, len(by)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x[by].astype(np.int32))) for x in (pairs >> 32, pairs & 0xFFFFFFFF, n)]
                yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), *lists], ["part", "left", "word", "n"])

    return run


def _frequent(least: int) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        left, word, n = (np.concatenate([np.zeros(0, np.int32), *(c.flatten().to_numpy() for c in rows.column(x).chunks)]).astype(np.int64) for x in ("left", "word", "n"))
        pairs, at = np.unique(left << 32 | word, return_inverse=True)
        f = np.zeros(len(pairs), np.int64)
        np.add.at(f, at, n)
        pairs, f = pairs[f >= least], f[f >= least]
        return pa.table({"left": pa.array((pairs >> 32).astype(np.int32)), "word": pa.array((pairs & 0xFFFFFFFF).astype(np.int32)), "f": pa.array(f)})

    return run


def _own_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row in _rows_of(b):
            pairs = _longer(row)[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), row["block"])), pa.array((pairs >> 32).astype(np.int32)), pa.array((pairs & 0xFFFFFFFF).astype(np.int32))], ["block", "left", "word"])


def _numbered(rows: DataFrame, tag: str) -> DataFrame:
    """The rows written, with int numbers from 0 as id."""
    rows = materialize(rows.withColumn("at", F.monotonically_increasing_id()), tag)
    part = F.shiftright("at", 33).cast("int")
    n = {r["part"]: r["count"] for r in rows.groupBy(part.alias("part")).count().collect()}  # a row a partition
    if sum(n.values()) >= 1 << 31:
        raise OverflowError("more frequent phrases of a length than ints")
    before = np.cumsum([0, *(n.get(k, 0) for k in range(max(n, default=0)))]).tolist()
    return rows.withColumn("id", (F.get(F.array(*map(F.lit, before)), part) + F.col("at").bitwiseAND((1 << 33) - 1)).cast("int")).drop("at")


def mined(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(lang, n words in all) and (lang, phrase, words, f): all words and phrases of up to ``longest`` words that occur ``least`` times."""
    posted = materialize(postings(docs, text, lang, block), "postings", **ROWS)
    single = posted.select("block", F.explode(F.arrays_zip("lang", "word", "n")).alias("x")).select("block", "x.lang", "x.word", "x.n")
    words = _numbered(single.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least), "frequent")
    totals = materialize(single.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    parts = max(PARTS, (totals.agg(F.sum("n")).first()[0] or 0) // SUMMED)
    named = _named(posted, words.select("lang", "word", "id"), F.octet_length("word") + 64, lambda: single.drop("n"), _words_as_known, _known_words)
    level = materialize(named, "lists", **ROWS)
    discard(posted)
    known = words.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("words"), "f", "id")
    every = [known]
    for k in range(1, longest):
        sums = level.mapInArrow(_lengths(parts), "part int, left array<int>, word array<int>, n array<int>").groupBy("part").applyInArrow(_frequent(least), "left int, word int, f long")
        frequent = _numbered(sums, "frequent")
        done = level
        if k + 1 < longest:
            own = lambda level=level: level.mapInArrow(_own_pairs, "block long, left int, word int")
            level = materialize(_named(level, frequent.select("left", "word", "id"), F.lit(16), own, _phrases_as_known, _known_phrases), "lists", **ROWS)
        discard(done)
        phrases = frequent.join(known.select(F.col("id").alias("left"), "lang", "phrase"), "left").join(words.select(F.col("id").alias("word"), F.col("word").alias("last")), "word")
        known = materialize(phrases.select("lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), F.lit(k + 1).alias("words"), "f", "id"), "phrases")
        every.append(known)
    return totals, reduce(DataFrame.unionByName, every).drop("id")


def scored(totals: DataFrame, phrases: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score, cut: each phrase of two words or more by its lowest-scoring cut, ties to the earliest. Exact: 38 digits."""
    part = lambda a, n: F.array_join(F.slice("ws", a, n), " ")
    cuts = phrases.where("words > 1").withColumn("ws", F.split("phrase", " ")).select("lang", "phrase", F.col("f").alias("a"), "ws", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("first"), part(F.col("cut") + 1, F.size("ws") - F.col("cut")).alias("rest"))
    for side, name in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(phrases.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    long = lambda c: c.cast("decimal(18,0)")
    cuts = cuts.join(totals, "lang").withColumns({"over": long(1000 * F.col("a")) * long(F.col("n")), "under": long(F.col("l")) * long(F.col("r"))})
    lowest = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(F.expr("over div under").alias("score"), "cut", "l", "r")).alias("m"))
    return lowest.select("lang", "phrase", "a", "m.l", "m.r", "n", "m.score", "m.cut")


def widest(phrases: DataFrame) -> DataFrame:
    """Phrases of two words or more that do not lie in a longer one of the same frequency.

    A longer phrase is no more frequent than one in it; so if any longer one is as frequent, one by just one word longer is.
    """
    many = phrases.where("words > 1")
    ws = F.split("phrase", " ")
    inner = F.array(F.slice(ws, F.lit(1), F.col("words") - 1), F.slice(ws, F.lit(2), F.col("words") - 1))
    covered = many.where("words > 2").select("lang", F.explode(inner).alias("ws"), "f").select("lang", F.array_join("ws", " ").alias("phrase"), "f").distinct()
    return many.join(covered, ["lang", "phrase", "f"], "left_anti")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, shown: int = SHOWN, block: int = BLOCK) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases by score, frequency, phrase (in byte order), as many as are shown."""
    totals, phrases = mined(docs, text, lang, least, longest, block)
    found = scored(totals, phrases).join(widest(phrases).select("lang", "phrase"), ["lang", "phrase"])
    # What is not among the best of its part of a language is not among the best of the language, so no task ranks all phrases of one.
    order = [F.desc("score"), F.desc("a"), "phrase"]
    best = lambda rows, *by: rows.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= shown)
    ranked = best(best(found.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))), "lang", "_part"), "lang")
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", "cut")


def op13(spark, sf_dir: str) -> DataFrame:
    """Collocations of each language over all documents."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("cut")


OP13_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM d),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM p GROUP BY lang),
g AS (SELECT lang, k, ws[i:i + k - 1] AS ws FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM p, (SELECT unnest(range(1, 6)) AS k) WHERE len(ws) >= k)),
f AS (SELECT lang, k, ws, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, k, ws, f AS a, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
s AS (SELECT c.lang, c.k, c.ws, a, cut, x.f AS l, y.f AS r, n, CAST((CAST(1000 AS HUGEINT) * a * n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.ws = c.ws[1:cut] JOIN f y ON y.lang = c.lang AND y.ws = c.ws[cut + 1:] JOIN n ON n.lang = c.lang),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, cut) = 1),
o AS (SELECT DISTINCT lang, ws[i:i + j - 1] AS ws, f FROM (SELECT lang, ws, f, k, j, unnest(range(1, k - j + 2)) AS i FROM f, (SELECT unnest(range(2, 5)) AS j) WHERE j < k)),
t AS (SELECT lang, array_to_string(ws, ' ') AS phrase, a, l, r, n, score FROM m WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.lang = m.lang AND o.ws = m.ws AND 100 * o.f >= 100 * m.a)),
u AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM t)
SELECT lang, rank, phrase, a, l, r, n, score FROM u WHERE rank <= 2000
"""

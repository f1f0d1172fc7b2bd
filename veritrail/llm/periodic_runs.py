"""Periodic runs of words by a harmonic grid of longest common extensions.

A run is a stretch of words with a smallest period q, at least max(12, 2 q) words long, that no neighbouring word extends. For each period p,
the words at jp and (j + 1)p are compared: the words equal from there on (forward extension) and before (backward extension) give the
stretch of period p around them. A stretch as long as a run holds a grid point, so all runs are found, with n / 1 + n / 2 + ... points.
Extensions are range minima over the common prefixes of neighbours in a suffix array, and in that of the reversed words. A grid point
whose own words differ, or that has fewer than three equal words on either side of it, can't be in a run, as a run has six equal pairs at least;
these are told by the words themselves, and documents without other points need no arrays.

The same stretch is found by multiples of its period; the least counts. Documents are taken in batches of bounded size, with a word of its own
between them, so that no extension leaves a document. Nothing is shuffled. A very long document is a batch of its own, with its arrays in
memory (about 8 bytes a word for each doubling of its longest repeat); grid points go in pieces of bounded size.

Null, empty and blank texts have no words and no runs. Rows are independent: repeated rows repeat their result, and rows without a
doc_id have theirs (in the query with their words as they are). Extra columns take no part; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import slices

#: Least length of a run, and how many periods it has at least.
LEAST, TIMES = 12, 2
#: Words of a batch beyond one document, and grid points looked at in one go.
BATCH_WORDS, POINTS = 1 << 17, 1 << 20


class Extensions:
    """Longest common prefixes of any two suffixes of a word array whose last word is like no other."""

    def __init__(self, ids: np.ndarray):
        n, order = len(ids), np.argsort(ids, kind="stable")
        edge = np.flatnonzero(np.concatenate([[True], ids[order][1:] != ids[order][:-1]]))
        rank = np.empty(n, np.int32)
        sizes = np.diff(np.append(edge, n))
        rank[order] = np.repeat(edge, sizes)
        levels, step, todo = [rank], 1, order[np.repeat(sizes, sizes) > 1]
        # Prefix doubling: ranks by the first 2, 4, 8 ... words, of those suffixes only that still share a rank.
        while len(todo):
            key = rank[todo].astype(np.int64) * n + rank[todo + step]
            by = np.argsort(key, kind="stable")
            todo, key = todo[by], key[by]
            new = np.concatenate([[True], key[1:] != key[:-1]])
            old = rank[todo]
            group = np.concatenate([[True], old[1:] != old[:-1]])
            at, first = np.arange(len(todo)), np.flatnonzero(new)
            first_of_group = np.maximum.accumulate(np.where(group, at, 0))
            first_of_new = np.maximum.accumulate(np.where(new, at, 0))
            rank = rank.copy()
            rank[todo] = old + (first_of_new - first_of_group)
            sizes = np.diff(np.append(first, len(todo)))
            todo = todo[np.repeat(sizes, sizes) > 1]
            levels.append(rank)
            step *= 2
        suffixes = np.empty(n, np.int32)
        suffixes[rank] = np.arange(n, dtype=np.int32)
        a, b = suffixes[:-1], suffixes[1:]
        common = np.zeros(n - 1, np.int32)
        for k in range(len(levels) - 2, -1, -1):
            common += (levels[k][a + common] == levels[k][b + common]).astype(np.int32) << k
        del levels
        self.rank, least = rank, [common]
        while 2 << (len(least) - 1) <= n - 1:
            half = 1 << (len(least) - 1)
            least.append(np.minimum(least[-1][:-half], least[-1][half:]))
        self.least = least

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words are equal from i and from j on (i and j differ)."""
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(i), np.int32)
        for k in np.unique(level).tolist():
            at = level == k
            out[at] = np.minimum(self.least[k][low[at]], self.least[k][high[at] - (1 << k)])
        return out


@dataclass
class Runs:
    """start, length and period of runs, by document (a number in the batch), start and period."""

    document: np.ndarray
    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


def _grid(lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """document, place of the first word in the document, period: all grid points with (j + 1)p inside, in pieces, periods ascending in each document."""
    documents = np.repeat(np.arange(len(lengths)), lengths // TIMES)
    firsts = np.cumsum(lengths // TIMES) - lengths // TIMES
    periods = np.arange(len(documents)) - firsts[documents] + 1
    counts = (lengths[documents] - 1) // periods
    sums = np.concatenate([[0], np.cumsum(counts)])
    at = 0
    while at < len(documents):
        to = max(at + 1, int(np.searchsorted(sums, sums[at] + POINTS, "right")) - 1)
        n = counts[at:to]
        which = np.repeat(np.arange(at, to), n)
        j = np.arange(sums[at], sums[to]) - sums[which]
        yield documents[which], j * periods[which], periods[which]
        at = to


def runs(documents: list[np.ndarray]) -> Runs:
    """The runs of documents given as arrays of word numbers (not negative)."""
    lengths = np.array([len(d) for d in documents], np.int64)
    # Three words before each document and after the last are like no others.
    gaps = iter(range(-1, -3 * len(documents) - 4, -1))
    gap = lambda: np.array([next(gaps), next(gaps), next(gaps)], np.int32)
    words = np.concatenate([x for d in documents for x in (gap(), d.astype(np.int32))] + [gap()])
    base = 3 + np.cumsum(lengths + 3) - (lengths + 3)
    points = []
    for document, place, period in _grid(lengths):
        i = base[document] + place
        keep = np.flatnonzero(words[i] == words[i + period])
        i, p = i[keep], period[keep]
        same = lambda k, i=i, p=p: words[i + k] == words[i + k + p]
        near = (same(1) & same(2)) | (same(-1) & same(-2) & same(-3))
        points.append((document[keep][near], i[near], p[near]))
    document, i, p = (np.concatenate(x) for x in zip(*points, strict=True)) if points else (np.zeros(0, np.int64),) * 3
    if not len(i):
        return Runs(*(np.zeros(0, np.int64) for _ in range(4)))
    # Only documents with points left need the arrays.
    needed = np.unique(document)
    kept = np.concatenate([np.arange(base[d] - 3, base[d] + lengths[d]) for d in needed.tolist()] + [np.arange(len(words) - 3, len(words))])
    moved = np.zeros(len(words), np.int64)
    moved[kept] = np.arange(len(kept))
    some = words[kept]
    forward, backward = Extensions(some), Extensions(some[::-1])
    found = np.zeros((0, 4), np.int64)
    for at in range(0, len(i), POINTS):
        d, a, q = document[at : at + POINTS], i[at : at + POINTS], p[at : at + POINTS]
        m = moved[a]
        before = backward(len(some) - m, len(some) - m - q)
        length = before + q + forward(m, m + q)
        good = length >= np.maximum(LEAST, TIMES * q)
        found = np.concatenate([found, np.stack([d, a - before - base[d], length, q], axis=1)[good]])
        # A stretch is found once for each grid point in it and each multiple of its period: the least period stays.
        found = found[np.lexsort((found[:, 3], found[:, 2], found[:, 1], found[:, 0]))]
        found = found[np.concatenate([[True], (found[1:, :3] != found[:-1, :3]).any(axis=1)])] if len(found) else found
    found = found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]
    return Runs(*(found[:, k] for k in range(4)))


def kept_words(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether each of n words stays when of every run only its first period does."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    return np.cumsum(change[:-1]) == 0


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, len(words))


def repeated(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of a tenth of all documents, told by the id's CRC, with a tail that repeats a part of them; all others as they are."""
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    part = words[a : a + 1 + (n - a) // (3 + g % 8)]
    return words[:a] + (part * ((n - a) // len(part) + 1))[: n - a]


def batches(rows: Iterable[tuple[object, list[bytes]]]) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Rows in lists of bounded numbers of words beyond one row."""
    some, n = [], 0
    for key, words in rows:
        if some and n + len(words) > BATCH_WORDS:
            yield some
            some, n = [], 0
        some.append((key, words))
        n += len(words)
    if some:
        yield some


RESULT = "doc_id long, n_words long, starts array<long>, lengths array<long>, periods array<long>, collapsed string"


def periodic_runs(docs: DataFrame, text: str = "text", planted: bool = False, collapse: bool = True) -> DataFrame:
    """doc_id, n_words, the runs by start and period as three arrays, and the text with each run cut down to its first period (words joined by blanks).

    planted: words as ``repeated`` gives them. A row per document, in its partition.
    """

    def found(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((d, (t or b"").split()) for b in slices(given) for d, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True))
        if planted:
            rows = ((d, repeated(w, d)) for d, w in rows)
        for some in batches(rows):
            r = runs([numbered(w) for _, w in some])
            cut = np.searchsorted(r.document, np.arange(len(some) + 1))
            parts = [tuple(x[a:z] for x in (r.start, r.length, r.period)) for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            left = [(b" ".join(w) if not len(s) else b" ".join(x for x, k in zip(w, kept_words(len(w), s, n, p).tolist(), strict=True) if k)).decode() if collapse else None for (_, w), (s, n, p) in zip(some, parts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([d for d, _ in some], pa.int64()), pa.array([len(w) for _, w in some], pa.int64()), *(pa.array([x[k] for x in parts], pa.list_(pa.int64())) for k in range(3)), pa.array(left, pa.string())],
                ["doc_id", "n_words", "starts", "lengths", "periods", "collapsed"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(found, RESULT)


def op11(spark, sf_dir: str) -> DataFrame:
    """Runs of all documents: the longest of each (ties to the smallest start, then period), and digests of all of them and of the collapsed text."""
    each = periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), planted=True)
    order = F.transform(F.arrays_zip("starts", "lengths", "periods"), lambda r: F.struct((-r["lengths"]).alias("shorter"), r["starts"].alias("start"), r["periods"].alias("period")))
    lines = F.transform(F.arrays_zip("starts", "lengths", "periods"), lambda r: F.concat(F.concat_ws(",", r["starts"], r["lengths"], r["periods"]), F.lit("\n")))
    each = each.withColumn("best", F.array_min(order)).withColumn("all", F.concat_ws("", lines))
    return each.select(
        "doc_id", F.size("starts").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.shorter")).alias("length"), F.col("best.period").alias("period"),
        F.expr("(1000 * -best.shorter) div best.period").alias("exponent_milli"), F.sha2("all", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )

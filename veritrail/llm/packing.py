"""Best-fit packing by minimum bin slack.

A piece's length is one of at most ``capacity`` values, so the whole problem is a histogram of that many counts, however many pieces
there are. Per bin, the longest length left is taken and a bitset subset-sum dynamic programme over the lengths left (a Python integer
as the bitset) finds the fullest combination beside it; the combination is removed as often as the counts allow at once. The plan is
bounded by the number of lengths, and pieces find their place in it by their rank among those of their length.

Tasks number their own pieces of each length while they cut documents, in parts of ``PART`` pieces, so a hot length lands in no single
task. Counts by part are shuffled, the histogram goes to the driver, and pieces are joined to their part's first rank.

Ids are the tokenizer's own: its special tokens, where a text spells them, are those tokens. They are looked for in the text as it
stands, before it is lower-cased, as the tokenizer does.

A null or empty text has the end token alone. Very long texts are encoded whole and cut into as many pieces as it takes. Repeated rows
are packed as often as they occur. A null doc_id is kept. Extra columns take no part. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
import string
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import materialize, slices

CAPACITY = 2048
#: Stands behind the last token of a word; no id is as large.
NOTHING = 0xFFFF
#: ASCII marks that, behind a letter, are tokens apart from it; the apostrophe may belong to a contraction.
MARKS = string.punctuation.replace("'", "")
#: Pieces of one length that share a part, and with it a key of the join that places them.
PART = 1024
#: Distinct words whose ids a worker keeps; beyond it, only those just seen stay.
CACHE_WORDS = 560_000


def public_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")

#: Letters of a word up to which merges are applied to many words at once, which takes time with the square of the length.
LONG_WORD = 64


class Merges:
    """The merges of a byte-level BPE with word ends, over many words at once as arrays."""

    def __init__(self, path: str):
        model = json.loads(Path(path).read_text())["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        # The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        symbol = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}
        self.first, self.last = (np.array([vocab[symbol[b] + x] for b in range(256)], np.int64) for x in ("", end))
        self.none = len(pairs)
        self.made = np.array([vocab[x + y] for x, y in pairs] + [0], np.int64)
        self.keys = np.array([vocab[x] << 16 | vocab[y] for x, y in pairs] + [-1], np.int64)
        # The rank of a pair by a table of chains: its head by a hash of the pair, then the next rank of the same hash.
        self.heads, self.following = np.full(1 << 20, self.none, np.int64), np.full(self.none + 1, self.none, np.int64)
        for rank, slot in enumerate(self._slot(self.keys[:-1]).tolist()):
            self.following[rank], self.heads[slot] = self.heads[slot], rank

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a << 16 | b
        at = self.heads[self._slot(keys)]
        while (wrong := (at != self.none) & (self.keys[at] != keys)).any():
            at = np.where(wrong, self.following[at], at)
        return at

    def encode(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Each word, which must be free of upper case and marks, with its ids as 32-bit numbers: the best pair is merged, over and over."""
        by_length: dict[int, list[bytes]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        for size, some in by_length.items():
            text = np.frombuffer(b"".join(some), np.uint8).reshape(-1, size)
            ids = np.concatenate([self.first[text[:, :-1]], self.last[text[:, -1:]], np.full((len(some), 1), NOTHING)], axis=1)
            ranks, rows, columns = self.ranks(ids[:, :-1], ids[:, 1:]), np.arange(len(some)), np.arange(size)
            while True:
                at = ranks.argmin(axis=1)
                best = ranks[rows, at]
                live = best < self.none
                if not live.any():
                    break
                at = np.where(live, at, size)[:, None]
                ids[:, :-1] = np.where(columns > at, ids[:, 1:], ids[:, :-1])
                ranks[:, :-1] = np.where(columns[:-1] > at, ranks[:, 1:], ranks[:, :-1])
                r, c = rows[live], at[live, 0]
                ids[r, c] = self.made[best[live]]
                ranks[r, c] = self.ranks(ids[r, c], ids[r, c + 1])
                r, c = r[c > 0], c[c > 0] - 1
                ranks[r, c] = self.ranks(ids[r, c], ids[r, c + 1])
            counts = (ids != NOTHING).sum(axis=1).tolist()
            data, step = ids.astype(np.uint32).tobytes(), 4 * (size + 1)
            for i, (w, n) in enumerate(zip(some, counts, strict=True)):
                yield w, data[i * step : i * step + 4 * n]


class WordEncoder:
    """Ids of whole texts by a tokenizer whose tokens never span white space, through a cache of words.

    Words of lower-case letters below U+0180, on which normalizing and splitting change nothing, go through ``Merges``; the first ones are
    compared with the tokenizer's own ids, and all go to the tokenizer if one differs.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Special tokens, cut from the raw texts; what is left between them has none, whatever lower-casing makes of it.
        self.specials = {e.content: array("I", [i]).tobytes() for i, e in self.tokenizer.get_added_tokens_decoder().items()}
        if any(e.normalized or e.lstrip or e.rstrip or e.single_word for e in self.tokenizer.get_added_tokens_decoder().values()):
            raise ValueError("special tokens that take in what stands beside them are not supported")
        self.special = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")") if self.specials else None
        self.tokenizer.encode_special_tokens = True
        self.merges: Merges | None = Merges(path)
        self.compared = False
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.cache_words = cache_words

    def encode(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        for w, e in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False), strict=True):
            yield w, array("I", e.ids).tobytes()

    def learn(self, words: set[str]) -> None:
        """Puts the words into the cache, from the older half of it where they are there."""
        older, cache = self.older, self.cache
        if found := words & older.keys():
            cache.update((w, older[w]) for w in found)
            words = words - found
        # Marks after a letter are tokens of their own, so the word before them is often known already. (A capital I with a dot ends in a mark, in lower case.)
        ends = {w: (bare, w[len(bare) :]) for w in words if (bare := w.rstrip(MARKS)) and bare != w and bare[-1].lower().isalpha()}
        if ends:
            words = words.difference(ends)
            parts = {x for pair in ends.values() for x in pair}.difference(cache)
            cache.update((w, older[w]) for w in parts & older.keys())
            words |= parts.difference(cache)
        plain = [w for w in words if len(w) <= LONG_WORD and w.isalpha() and w.islower() and max(w) < "\u0180"] if self.merges else []
        if plain and not self.compared:
            self.compared, some = True, plain[:2000]
            if dict(self.encode(some)) != {w.decode(): i for w, i in self.merges.encode([w.encode() for w in some])}:
                self.merges, plain = None, []
        cache.update(self.encode(list(words.difference(plain))))
        if plain:
            cache.update((w.decode(), i) for w, i in self.merges.encode([w.encode() for w in plain]))
        cache.update((w, cache[bare] + cache[marks]) for w, (bare, marks) in ends.items())

    def batch(self, texts: pa.Array) -> Iterator[bytes]:
        """Each text's ids as 32-bit numbers."""
        raw = texts.to_pylist() if self.special is not None and any(pc.any(pc.match_substring(texts, s)).as_py() for s in self.specials) else []
        if not raw:
            yield from self.plain(texts)
            return
        cut = [self.special.split(t) for t in raw]  # texts at even places, special tokens between them
        ids = self.plain(pa.array([x for xs in cut for x in xs[::2]], pa.string()))
        for xs in cut:
            yield b"".join(self.specials[x] if i % 2 else next(ids) for i, x in enumerate(xs))

    def plain(self, texts: pa.Array) -> Iterator[bytes]:
        """Each text's ids, special tokens as any other characters. ASCII letters are lower-cased first, as the tokenizer lower-cases all.

        Words are numbered by Arrow; the ids of the distinct ones are looked up, and all words' ids taken from these as arrays.
        """
        if len(self.cache) > self.cache_words // 2:
            self.cache, self.older = {}, self.cache
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.cache.get, words))
        if None in ids:
            self.learn({w for w, i in zip(words, ids, strict=True) if i is None})
            ids = list(map(self.cache.get, words))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        pool, starts = np.frombuffer(b"".join(ids), np.uint32), np.cumsum(sizes) - sizes
        which = coded.indices.to_numpy()
        n = sizes[which]
        ends = np.cumsum(n)
        all_ids = pool[np.repeat(starts[which] - (ends - n), n) + np.arange(n.sum())]
        edges = np.concatenate([[0], ends])[lists.offsets.to_numpy() - lists.offsets[0].as_py()].tolist()
        for a, z in zip(edges, edges[1:], strict=False):
            yield all_ids[a:z].tobytes()


def cut(lengths: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of a document of that many tokens."""
    for start in range(0, lengths, capacity):
        yield start, min(capacity, lengths - start)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit numbers), and part and rank: the piece's number among the pieces of its length in that part."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, first, seen, last = WordEncoder(path), TaskContext.get().partitionId() << 32, [0] * (capacity + 1), array("I", [end_id]).tobytes()
        for some in slices(batches, 1024):
            rows: list[tuple] = []
            for doc_id, ids in zip(some.column(0).to_pylist(), coder.batch(some.column(1)), strict=True):
                ids += last
                for k, (start, n) in enumerate(cut(len(ids) // 4, capacity)):
                    rows.append((doc_id, k, start, n, ids[4 * start : 4 * (start + n)], first + seen[n] // PART, seen[n] % PART))
                    seen[n] += 1
            for at in range(0, len(rows), 2048):  # a document may have any number of pieces
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 2048], strict=True), types, strict=True)], names)

    names = ["doc_id", "piece", "start", "length", "ids", "part", "rank"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(encode, "doc_id long, piece int, start long, length long, ids binary, part long, rank long")


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of the lengths (descending) that fills room best, by bitset subset sums; longer pieces are preferred."""
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    for n in lengths:
        if n > room:
            continue
        before = reach
        for _ in range(min(counts[n], room // n)):
            wider = reach | (reach << n) & mask
            if wider == reach:
                break
            reach = wider
        steps.append((n, before))
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for n, before in reversed(steps):
        k = next(k for k in range(at // n + 1) if before >> (at - k * n) & 1)
        if k:
            used[n] = k
            at -= k * n
    return used


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Rows (length, first rank, first bin, pieces of that length per bin, offset of the first) and the number of bins.

    Ranks from the first one on go to the bins from the first one on, so many per bin, up to the next row of that length.
    """
    left, taken, rows, bins = dict(histogram), dict.fromkeys(histogram, 0), [], 0
    lengths = sorted(left, reverse=True)
    while lengths:
        longest = lengths[0]
        left[longest] -= 1
        use = fullest(lengths, left, capacity - longest)
        left[longest] += 1
        use[longest] = use.get(longest, 0) + 1
        times, at = min(left[n] // k for n, k in use.items()), 0
        for n, k in sorted(use.items(), reverse=True):
            rows.append((n, taken[n], bins, k, at))
            taken[n] += k * times
            left[n] -= k * times
            at += k * n
        bins += times
        lengths = [n for n in lengths if left[n]]
    return rows, bins


def placed(some: DataFrame, rows: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """Pieces (length, rank over all pieces of that length) with sequence_id and offset, by the plan's rows: a list for each length, broadcast."""
    known = some.sparkSession.createDataFrame(rows, "length long, at long, bin long, k long, offset long")
    known = known.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("at", "bin", "k", "offset"))).alias("_rows"))
    some = some.join(F.broadcast(known), "length")  # a row for each length, so at most ``capacity``
    some = some.withColumn("_row", F.element_at(F.filter("_rows", lambda r: r["at"] <= F.col("rank")), -1)).withColumn("_past", F.col("rank") - F.col("_row.at"))
    offset = F.col("_row.offset") + F.col("_past") % F.col("_row.k") * F.col("length")
    return some.withColumns({"sequence_id": F.col("_row.bin") + F.expr("_past div _row.k"), "offset": offset}).drop("_rows", "_row", "_past", "rank")


def digests(some: DataFrame) -> DataFrame:
    """The rows with the CRC-32 of their ids in place of these."""
    return some.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset in place of part and rank. They are written once, as two later steps read them."""
    cut_pieces = materialize(cut_pieces, "pieces")
    counts = cut_pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    first = counts.select("length", "part", (F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")).alias("first"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    rows, _ = plan(histogram, capacity)

    some = cut_pieces.join(first, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("first")).drop("part", "first")
    kept = [c for c in cut_pieces.columns if c not in ("part", "rank")]
    return placed(some, rows).select(*kept, "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and ids: the tokens of each sequence, its pieces in order of their offsets. A sequence has ``capacity`` tokens at most."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: F.hex(p["ids"]))
    return packed.groupBy("sequence_id").agg(F.unhex(F.array_join(parts, "")).alias("ids"))


def op2(spark, sf_dir: str) -> DataFrame:
    """All documents, cut into pieces of at most 2048 tokens and packed into sequences of at most 2048; digests are of the packed pieces' ids."""
    return digests(pack(pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizer())))

"""Near duplicates by circulant MinHash, banding and exact Jaccard verification.

Words are lower-cased in A-Z and hashed to 64 bits, a document's set is its distinct 5-word shingles (all words as one where there are
fewer). Circulant MinHash needs two permutations of the 32-bit universe: the first is applied once, the second, circularly shifted
by k, gives coordinate k of the signature. Bands of 4 coordinates, 32 of them, make two documents of similarity 0.75 candidates but for
5 in a million.

Equal word sequences are one class from the start. In each band bucket, members are first compared with the bucket's smallest member
only, by the sets themselves; after connected components, those outside the smallest component are compared with the smallest of their own
in the same way. Only then are members of one bucket that are still in different components compared with each
other, first by bitmaps of their sets (in blocks of bounded size), then again by the sets. Where two bitmaps differ, so do the sets, so
what the bitmaps rule out is certainly not linked. So no bucket emits all its pairs, and no bucket is capped: every two members that
could still be linked are compared. Sets are made only of documents that share a bucket. What a bucket's members need to know of it is
aggregated and joined back, so that none is sorted or held as a whole.

A link needs 100 * intersection >= 75 * union on the full sets. Documents without words (null, empty, blank) have no set and stand
alone. Very long texts are read whole. Repeated rows are in one class. A null doc_id belongs to its class but never names it, unless all are null. Extra columns take no part; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import WS, materialize
from .components import components

WORDS, PERCENT = 5, 75
BANDS, ROWS = 32, 4
#: Bits of the largest bitmap of a set; smaller sets have 8 to 16 bits a shingle.
MAP_BITS = 1 << 15
#: Members of a bucket compared with each other in one go.
BLOCK = 512

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.isin(np.arange(256), [ord(c) for c in WS])
_BYTE = np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.uint64)
_P, _Q, _M = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers (the finalizer of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of an odd base modulo 2 ** 64, and their inverses."""
    have = _powers.get(base)
    if have is None or len(have[0]) <= n:
        size = 1 << max(16, int(n).bit_length())
        have = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)]), dtype=np.uint64) for b in (base, pow(base, -1, 1 << 64)))
        _powers[base] = have
    return have


def ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of each range of values."""
    up, down = powers(base, len(values))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)], dtype=np.uint64)])
    return (sums[ends] - sums[starts]) * down[starts]


def shingles(texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Each text's sorted distinct shingle hashes, and two hashes of its word sequence."""
    data = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    hashed = mix(ranges(_BYTE[_LOWER[data]], starts, ends, _P) + (ends - starts).astype(np.uint64))
    at = 1 + np.cumsum([0] + [len(t) + 1 for t in texts])
    first = np.searchsorted(starts, at)
    n = np.diff(first).astype(np.uint64)
    k1, k2 = (mix(ranges(hashed, first[:-1], first[1:], b) + n) for b in (_P, _Q))
    windows = np.zeros(0, np.uint64)
    if len(hashed) >= WORDS:
        windows = np.zeros(len(hashed) - WORDS + 1, np.uint64)
        for k in range(WORDS):
            windows += hashed[k : len(hashed) - WORDS + 1 + k] * _U(pow(_M, k, 1 << 64))
        windows = mix(windows)
    sets = [np.unique(windows[a : b - WORDS + 1]) if b - a >= WORDS else k1[i : i + 1] if b > a else windows[:0] for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True))]
    return sets, k1, k2


#: Shifts and odd factors of the two permutations.
FIRST, SECOND = ((15, 0xD168AAAD), (15, 0xAF723597)), ((16, 0x7FEB352D), (15, 0x846CA68B))


def permute(x: np.ndarray, room: np.ndarray, steps: tuple[tuple[int, int], ...]) -> np.ndarray:
    """A bijection of 32-bit numbers, in place."""
    for shift, factor in steps:
        np.right_shift(x, np.uint32(shift), out=room)
        np.bitwise_xor(x, room, out=x)
        np.multiply(x, np.uint32(factor), out=x)
    np.right_shift(x, np.uint32(16), out=room)
    return np.bitwise_xor(x, room, out=x)


def signatures(sets: list[np.ndarray], coordinates: int = BANDS * ROWS) -> np.ndarray:
    """Circulant MinHash of sets that are not empty: coordinate k is the least second(first(x) + k)."""
    out, at = np.empty((len(sets), coordinates), np.uint32), 0
    while at < len(sets):
        to, n = at, 0
        while to < len(sets) and (to == at or n + len(sets[to]) <= 1 << 15):
            n += len(sets[to])
            to += 1
        first = (np.concatenate(sets[at:to]) >> _U(32)).astype(np.uint32)
        offsets = np.cumsum([0] + [len(s) for s in sets[at : to - 1]])
        x, room = np.empty_like(first), np.empty_like(first)
        permute(first, room, FIRST)
        for k in range(coordinates):
            np.add(first, np.uint32(k), out=x)
            out[at:to, k] = np.minimum.reduceat(permute(x, room, SECOND), offsets)
        at = to
    return out


def band_keys(signed: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band; the band's number is part of it."""
    part, key = signed.reshape(len(signed), BANDS, ROWS).astype(np.uint64), np.arange(1, BANDS + 1, dtype=np.uint64) * _U(_Q)
    for r in range(ROWS):
        key = mix((key ^ part[:, :, r]) * _U(_P) + _U(r))
    return key.view(np.int64)


def _chunks(column: pa.Array, most: int = 1 << 17) -> Iterator[tuple[int, list[bytes]]]:
    """First row and texts of pieces of the column of about so many bytes."""
    at, some, n = 0, [], 0
    for i, x in enumerate(column.cast(pa.binary())):
        text = x.as_py() or b""
        if some and n + len(text) > most:
            yield at, some
            at, some, n = i, [], 0
        some.append(text)
        n += len(text)
    if some:
        yield at, some


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at, texts in _chunks(b.column(2)):
            sets, k1, k2 = shingles(texts)
            n = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(n)
            bands: list[list[int] | None] = [None] * len(sets)
            if len(full):
                for i, keys in zip(full, band_keys(signatures([sets[i] for i in full])).tolist(), strict=True):
                    bands[i] = keys
            part = b.slice(at, len(texts))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "row", "n_shingles", "k1", "k2", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for _, texts in _chunks(b.column(0)):
            sets, k1, k2 = shingles(texts)
            columns = [pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([bitmap(s).tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["k1", "k2", "shingles", "map"])


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """A bit for each shingle's hash; the size is a power of two, so a larger map can be folded to a smaller one's size."""
    bits = min(MAP_BITS, max(512, 1 << (8 * len(shingles) - 1).bit_length())) if len(shingles) else 512
    out = np.zeros(bits, bool)
    out[(shingles & _U(bits - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little")


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether 100 * intersection >= 75 * union of two sorted sets."""
    least = min(len(a), len(b))
    if 100 * least < PERCENT * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= PERCENT * (len(both) - common)


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        kept = [similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in zip(b.column(2), b.column(3), strict=True)]
        yield b.filter(pa.array(kept, pa.bool_())).select([0, 1])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) of classes whose sets are similar."""
    of = lambda c: sets.select(F.col("class").alias(c), F.col("shingles").alias(f"of_{c}"))
    return pairs.join(of("u"), "u").join(of("v"), "v").select("u", "v", "of_u", "of_v").mapInArrow(_linked, "u long, v long")


def close_pairs(comp: np.ndarray, n: np.ndarray, maps: list[bytes], left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Left rows, each with the right rows that may be linked and are in another component. Equal sides: each pair once.

    Sets of sizes a and b are linked if 7 * (number in just one of them) <= a + b, and the maps differ in no more places than the sets.
    """
    words = np.array([len(m) // 8 for m in maps])
    at = {size: np.flatnonzero((words == size) | (words == 2 * size)) for size in set(words.tolist())}
    own, same = {}, left is right
    for size, rows in at.items():
        table = np.zeros((len(rows), size), np.uint64)
        for k, i in enumerate(rows.tolist()):
            m = np.frombuffer(maps[i], np.uint64)
            table[k] = m if len(m) == size else m[:size] | m[size:]
        own[size] = (np.full(len(maps), -1), table)
        own[size][0][rows] = np.arange(len(rows))
    for a in left.tolist():
        other = right[right > a] if same else right
        other = other[(comp[other] != comp[a]) & (100 * np.minimum(n[other], n[a]) >= PERCENT * np.maximum(n[other], n[a]))]
        for size in set(np.minimum(words[other], words[a]).tolist()):
            some = other[np.minimum(words[other], words[a]) == size]
            where, table = own[size]
            apart = np.bitwise_count(table[where[some]] ^ table[where[a]]).sum(axis=1, dtype=np.int64)
            some = some[7 * apart <= n[some] + n[a]]
            if len(some):
                yield a, some


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of one bucket block pair that may be linked. Rows come sorted by (bucket, i, j)."""

    def pairs(rows: pa.Table) -> pa.RecordBatch | None:
        i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
        cls, comp, n, block = (rows.column(c).to_numpy() for c in ("class", "component", "n_shingles", "block"))
        left, bucket = np.flatnonzero(block == i), rows.column("bucket")[0].as_py()
        bands = np.array(rows.column("bands").to_pylist(), np.int64)
        us, vs = [], []
        for a, some in close_pairs(comp, n, rows.column("map").to_pylist(), left, left if i == j else np.flatnonzero(block == j)):
            # A pair that meets in several buckets is passed on by the first of them only.
            some = some[bands[some, np.argmax(bands[some] == bands[a], axis=1)] == bucket]
            us.append(np.maximum(cls[some], cls[a]))
            vs.append(np.minimum(cls[some], cls[a]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (us, vs)], ["u", "v"]) if us else None

    rest: pa.Table | None = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        key = np.stack([t.column(c).to_numpy() for c in ("bucket", "i", "j")])
        cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist()]
        for a, z in zip(cuts, cuts[1:], strict=False):
            if (out := pairs(t.slice(a, z - a))) is not None:
                yield out
        rest = t.slice(cuts[-1])
    if rest is not None and (out := pairs(rest)) is not None:
        yield out


def joined_back(members: DataFrame, per_key: DataFrame, key: str = "bucket") -> DataFrame:
    """members (a written table) with what is known of their bucket or component.

    That side is written first: both sides of the join are then shuffled as they are read, so Spark splits a key of very many members over tasks
    (its handling of skewed joins), and copies the other side's row to these tasks alone.
    """
    return members.join(materialize(per_key, "per_key"), key)


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id linked, by any chain), kept (doc_id is the component's id)."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(f"`{text}`").alias("text"))
    rows = materialize(given.mapInArrow(_signed, "doc_id long, row long, n_shingles long, k1 long, k2 long, bands array<long>"), "signatures")
    some = rows.where("n_shingles > 0")
    classes = some.groupBy("k1", "k2").agg(F.min("row").alias("class"), F.min("doc_id").alias("least"))
    classes = materialize(classes, "classes")
    one = some.join(classes.select(F.col("class").alias("row")), "row", "left_semi")

    members = one.select(F.col("row").alias("class"), F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.min("class").alias("hub"), F.max("class").alias("last")).where("hub < last").select("bucket", "hub")
    members = materialize(joined_back(members, shared), "buckets")

    needed = members.select("class").distinct()
    of = rows.select("doc_id", "k1", "k2", "bands", F.col("row").alias("class")).join(needed, "class", "left_semi")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    ids = of.select("doc_id").distinct()
    texts = texts.join(ids, texts["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi").select("text")
    sets = texts.mapInArrow(_sets, "k1 long, k2 long, shingles binary, map binary").join(of.select("k1", "k2", "class", "bands"), ["k1", "k2"]).select("class", "shingles", "map", "bands")
    sets = materialize(sets.dropDuplicates(["class"]), "sets")

    def linked(hubs: DataFrame) -> DataFrame:
        """Links of classes to the one hub that each meets in most buckets. hubs: class, hub."""
        best = hubs.groupBy("class", "hub").agg(F.count("*").alias("n")).groupBy("class").agg(F.max(F.struct("n", (-F.col("hub")).alias("to"))).alias("m"))
        return verified(best.select(F.col("class").alias("u"), (-F.col("m.to")).alias("v")), sets)

    def apart_of(links: DataFrame) -> DataFrame:
        """bucket, class, component, and the bucket's least component a, of the buckets whose members are in different components."""
        found = components(links).select(F.col("u").alias("class"), F.col("v").alias("component"))
        named = members.drop("hub").join(found, "class", "left").withColumn("component", F.coalesce("component", "class"))
        named = materialize(named, "named")
        mixed = named.groupBy("bucket").agg(F.min("component").alias("a"), F.max("component").alias("z"), F.count("*").alias("n")).where("a < z").drop("z")
        return joined_back(named, mixed)

    # First each member with the hub, then those of other components than the bucket's least with the least of theirs.
    links = materialize(linked(members.where("class <> hub").select("class", "hub")), "links")
    others = materialize(apart_of(links).where("component > a").select("bucket", "class", "component"), "others")
    seconds = others.groupBy("bucket").agg(F.min(F.struct("component", "class")).alias("hub"))
    more = joined_back(others, seconds).where("component > hub.component").select("class", F.col("hub.class").alias("hub"))
    links = materialize(links.unionByName(linked(more)), "links")

    # Then members of one bucket that are still apart.
    apart = apart_of(links).drop("a")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    apart = apart.join(sets.select("class", (F.octet_length("shingles") / 8).cast("long").alias("n_shingles"), "map", "bands"), "class")
    apart = apart.select("bucket", "class", "component", "n_shingles", "map", "bands", F.pmod(F.xxhash64("class"), blocks).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("with"))
    apart = apart.select("bucket", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "class", "component", "n_shingles", "map", "bands", "block")
    more = apart.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(_compared, "u long, v long")
    more = verified(more, sets)
    found = components(links.unionByName(more)).select(F.col("u").alias("class"), F.col("v").alias("component"))

    # Classes that stand alone need no component; the others get the least doc_id of theirs.
    linked_classes = materialize(found.unionByName(found.select(F.col("component").alias("class"), "component").distinct()), "linked")
    in_one = classes.join(linked_classes, "class")
    least = in_one.groupBy("component").agg(F.min("least").alias("component_id"))
    named = joined_back(in_one, least, "component").select("k1", "k2", "component_id")
    named = named.unionByName(classes.join(linked_classes, "class", "left_anti").select("k1", "k2", F.col("least").alias("component_id")))
    out = some.select("doc_id", "n_shingles", "k1", "k2").join(named, ["k1", "k2"]).select("doc_id", "n_shingles", "component_id")
    alone = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def distinct_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row of each group of near duplicates, with all its columns: that of the least doc_id, once however often it is repeated.

    Documents without words are no duplicates and stay, and so do rows without a doc_id. Rows of one doc_id with different texts stay
    together.
    """
    ids = near_duplicates(docs, text).where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    key = "_id"
    while key in docs.columns:
        key += "_"
    ids = materialize(ids.select(F.col("doc_id").alias(key), "kept", "n").where("NOT kept OR n > 1"), "dropped")
    same = lambda which: (ids.where(which), docs["doc_id"] == ids[key])
    twice = docs.join(*same(ids["kept"]), "left_semi").dropDuplicates(["doc_id", text])
    return docs.join(*same(F.lit(True)), "left_anti").unionByName(twice)


def op5(spark, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))

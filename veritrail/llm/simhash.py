"""Near duplicates by SimHash: segment popcounts as a grid, joined within a Manhattan distance, verified exactly.

A document's fingerprint has a bit set where more than half of its shingles' hashes (XXH64, seed 42) have it. Documents whose
fingerprints differ in at most 4 bits are linked.

A fingerprint is embedded as the numbers of bits set in its 32 segments of two bits: the Manhattan distance of two embeddings is never more
than the number of bits that differ. Segments make three parts (11, 11 and 10); over some two of them, linked fingerprints are at most 2 apart, as the
least two of three distances that sum to 4 sum to 2 at most. Cells of a grid are embeddings of two parts. A fingerprint goes to its own
cell and to those one step away, over each two parts: points at most 2 apart have such a cell in common. So no link is missed, at about 100 cells a
fingerprint; a cell tells about 32 bits, so few that are not near share one even among billions.

Equal fingerprints are one class from the start; only distinct ones are joined. In each cell, members are first compared with the cell's smallest;
after connected components, only members of different components are compared with each other, in blocks of bounded size. Every two members
that could still be linked are compared, by all their bits; only links leave a join. What the members of a cell need to know of it is written and
joined back: by broadcast up to a checked size, else so that Spark can split a cell of very many members over tasks. Cells are made anew where they
are needed rather than written.

Documents without words (null, empty, blank) have fingerprint zero and are linked like any other. Very long texts are read whole. Repeated rows are in
one class. A null doc_id belongs to its class but never names it, unless all are null. Extra columns take no part; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import if_small, materialize, slices
from .components import components

WORDS, SEED, APART = 4, 42, 4
#: Members of a cell compared with each other in one task's go.
BLOCK = 512
#: The lower bit of each segment of two bits.
LOW = np.uint64(0x5555555555555555)
#: Bits of the first part, and of the second.
PART = 22


def fingerprint(text: bytes | None) -> int:
    """The 64 bits of a text in UTF-8."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - WORDS + 1)
    last = ends[WORDS - 1 :] if len(words) >= WORDS else ends[-1:]
    one = xxhash.xxh64_intdigest
    hashes = np.fromiter((one(line[a:z], SEED) for a, z in zip(starts[:n].tolist(), last.tolist(), strict=True)), np.uint64, n)
    return int.from_bytes(np.packbits(2 * bit_counts(hashes) > n, bitorder="little").tobytes(), "little")


def bit_counts(hashes: np.ndarray, rows: int = 1 << 14) -> np.ndarray:
    """How many of the hashes have each bit, in pieces of bounded size."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), rows):
        some = hashes[at : at + rows].astype("<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return total


def _printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        prints = np.array([fingerprint(t) for t in b.column(1).cast(pa.binary()).to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints.view(np.int64))], ["doc_id", "print"])


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and print, the fingerprint as a signed long."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(_printed, "doc_id long, print long")


def cells(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The grid cells of fingerprints, and which fingerprint each is of. Which two parts a cell is of is part of its number."""
    u, rows, out = np.uint64, [], []
    first, second, last = prints & u((1 << PART) - 1), prints >> u(PART) & u((1 << PART) - 1), prints >> u(2 * PART)
    for kind, (parts, bits) in enumerate(((first | second << u(PART), 2 * PART), (first | last << u(PART), 64 - PART), (second | last << u(PART), 64 - PART))):
        own = parts - (parts >> u(1) & LOW)
        found = [(np.arange(len(prints)), own)]
        for at in range(0, bits, 2):
            count = own >> u(at) & u(3)
            up, down = np.flatnonzero(count < 2), np.flatnonzero(count > 0)
            found += [(up, own[up] + u(1 << at)), (down, own[down] - u(1 << at))]
        rows += [r for r, _ in found]
        out += [c << u(2) | u(kind) for _, c in found]
    return np.concatenate(out), np.concatenate(rows)


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 2048):
        prints = b.column(0).to_numpy()
        found, rows = cells(prints.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(prints[rows]), pa.array(found.view(np.int64))], ["print", "cell"])


def near(a: Column | str, b: Column | str) -> Column:
    """Whether two fingerprints differ in at most so many bits."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return F.bit_count(a.bitwiseXOR(b)) <= APART


def links(prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """u, v: links of distinct fingerprints (print) by which all that are near each other are connected."""
    spark = prints.sparkSession
    members = prints.select("print").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "print").mapInArrow(_placed, "print long, cell long")
    # The smallest and the largest member of each cell of more than one, and how many it has. A cell of two is done with them.
    shared = members.groupBy("cell").agg(F.min("print").alias("hub"), F.max("print").alias("last"), F.count("*").alias("n")).where("n > 1")
    shared = materialize(shared, "shared")
    twos = shared.where((F.col("n") == 2) & near("hub", "last")).select(F.col("last").alias("u"), F.col("hub").alias("v"))
    # In larger ones, all are compared with the smallest, then members of different components with each other.
    some = materialize(members.join(if_small(shared.where("n > 2").select("cell", "hub", "n"), F.lit(64)), "cell"), "large_cells")
    ones = some.where((F.col("print") > F.col("hub")) & near("print", "hub")).select(F.col("print").alias("u"), F.col("hub").alias("v"))
    found = materialize(twos.unionByName(ones).distinct(), "near_hub")

    named = components(found).select(F.col("u").alias("print"), F.col("v").alias("component"))
    some = materialize(some.drop("hub").join(named, "print", "left").withColumn("component", F.coalesce("component", "print")), "large_cells")
    mixed = some.groupBy("cell").agg(F.min("component").alias("a"), F.max("component").alias("z")).where("a < z").select("cell")
    some = some.join(materialize(mixed, "mixed"), "cell")
    blocks = F.ceil(F.col("n") / block).cast("int")
    some = some.select("cell", "print", "component", F.pmod(F.xxhash64("print"), blocks).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("with"))
    some = some.select("cell", "print", "component", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block")
    a, b = some.alias("a"), some.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("cell", "i", "j")]
    # The two sides are the blocks i and j, or the two orders of one block; each pair of a pair of blocks is compared once.
    sides = (F.col("a.block") == F.col("a.i")) & (F.col("b.block") == F.col("b.j")) & ((F.col("a.i") < F.col("a.j")) | (F.col("a.print") < F.col("b.print")))
    pairs = a.join(b, same[0] & same[1] & same[2] & sides & (F.col("a.component") != F.col("b.component")) & near("a.print", "b.print"))
    return found.unionByName(pairs.select(F.greatest("a.print", "b.print").alias("u"), F.least("a.print", "b.print").alias("v")).distinct())


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, print (the fingerprint as a signed long), component_id (the least doc_id linked, by any chain)."""
    rows = materialize(fingerprints(docs, text), "prints")
    classes = materialize(rows.groupBy("print").agg(F.min("doc_id").alias("least")), "print_classes")
    found = components(links(classes.select("print"))).select(F.col("u").alias("print"), F.col("v").alias("component"))
    found = found.unionByName(found.select(F.col("component").alias("print"), "component").distinct())
    named = classes.join(found, "print", "left").withColumn("component", F.coalesce("component", "print"))
    named = materialize(named, "print_components")
    least = materialize(named.groupBy("component").agg(F.min("least").alias("component_id")), "print_least")
    ids = materialize(named.join(least, "component").select("print", "component_id"), "print_ids")
    return rows.join(ids, "print").select("doc_id", "print", "component_id")


def op12(spark, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents, with the fingerprint in hexadecimal digits."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))

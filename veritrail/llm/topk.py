"""Exact top-k search by inner product: a KD-tree per shard.

Vectors are dealt to shards of bounded size by a hash of the whole row, so neither a common vector nor a common id makes a large shard.
Each shard's tree splits at the median of its widest dimension by position (so equal values split too) and keeps a tight box and the
least id per node. A block of queries goes through a group of shards: nodes are visited best bound first, the bound of a query and a box
being the sum over dimensions of the larger product with the box's two ends; the k-th score found so far goes on from shard to shard,
and that of the first group to all other groups, and ends each traversal. Ties at a bound are followed only where a smaller id may be. Blocks and groups are bounded, and each group
returns k rows a query at most.

Vectors that are null, or hold a null or a non-finite component, and rows without an id take no part. Rows that are equal in id and vector
count once. Shorter vectors are as if padded with zeros. Extra columns take no part; an empty table gives an empty result. Scores beyond
63 bits are cut to that range.
"""

from __future__ import annotations

import heapq
import io
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import materialize

SHARD_ROWS, LEAF_ROWS, GROUP_SHARDS, BLOCK_QUERIES = 4096, 64, 4, 8192
_EXACT, _LONG = 2.0**53, (1 << 63) - 1


def fixed_point(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of every component, x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def usable(vector: Column) -> Column:
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False))), F.lit(False))


def dump(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def load(blob: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(blob)) as f:
        return {k: f[k] for k in f.files}


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """A row for each list, padded with zeros."""
    out, offsets = np.zeros((len(vectors), width), np.int64), vectors.offsets.to_numpy()
    n = np.diff(offsets)
    values = vectors.values.to_numpy()[offsets[0] : offsets[-1]]
    out[np.repeat(np.arange(len(n)), n), np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], n)] = values
    return out


def build(ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF_ROWS) -> dict[str, np.ndarray]:
    """The tree: rows in leaf order; by node its first row, end, children (-1 for a leaf), box and least id."""
    order, nodes, todo = np.arange(len(ids)), [], [(0, len(ids), -1, 0)]
    while todo:
        a, z, parent, side = todo.pop()
        rows = vectors[order[a:z]]
        low, high = rows.min(axis=0), rows.max(axis=0)
        if parent >= 0:
            nodes[parent][2 + side] = len(nodes)
        nodes.append([a, z, -1, -1, low, high, ids[order[a:z]].min()])
        if z - a > leaf:
            mid = (z - a) // 2
            widest = int(np.argmax(high.astype(float) - low)) if rows.shape[1] else 0
            if rows.shape[1]:
                order[a:z] = order[a:z][np.argpartition(rows[:, widest], mid)]
            todo += [(a, a + mid, len(nodes) - 1, 0), (a + mid, z, len(nodes) - 1, 1)]
    a, z, left, right, low, high, least = zip(*nodes, strict=True)
    return {"ids": ids[order], "vectors": vectors[order], "a": np.array(a), "z": np.array(z), "left": np.array(left), "right": np.array(right), "low": np.array(low), "high": np.array(high), "least": np.array(least)}


def search(tree: dict[str, np.ndarray], ids: np.ndarray, queries: np.ndarray, k: int, best: list[list[tuple[int, int]]], least_score: np.ndarray) -> None:
    """Brings each query's heap of (score, -id) up to date with the tree's rows but those of its own id and those below its least score."""
    vectors, low, high = tree["vectors"], tree["low"].astype(float), tree["high"].astype(float)
    q = queries.astype(float)
    most = np.abs(q).sum(axis=1).max(initial=0) * np.abs(vectors.astype(float)).max(initial=0)
    exact = most < _EXACT
    bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    if not exact:
        bounds += 1e-12 * most
    rows = vectors.astype(float) if exact else vectors.astype(object)
    left, right, a, z, least = (tree[c].tolist() for c in ("left", "right", "a", "z", "least"))
    for i, (own, found, bar) in enumerate(zip(ids.tolist(), best, least_score.tolist(), strict=True)):
        bound, query = bounds[i].tolist(), q[i] if exact else queries[i].astype(object)
        todo = [(-bound[0], 0)]
        while todo:
            minus, node = heapq.heappop(todo)
            if -minus < bar:
                break
            if len(found) == k:
                kth, kth_id = found[0]
                if -minus < kth:
                    break
                if -minus == kth and least[node] > -kth_id:
                    continue
            if left[node] >= 0:
                for child in (left[node], right[node]):
                    heapq.heappush(todo, (-bound[child], child))
                continue
            scores = rows[a[node] : z[node]] @ query
            some = np.flatnonzero(scores >= (max(bar, found[0][0]) if len(found) == k else bar)).tolist()
            for j in some:
                entry = (int(scores[j]), -int(tree["ids"][a[node] + j]))
                if -entry[1] == own:
                    continue
                if len(found) < k:
                    heapq.heappush(found, entry)
                elif entry > found[0]:
                    heapq.heapreplace(found, entry)


def _parts(rows: DataFrame, size: int, seed: int) -> tuple[DataFrame, int]:
    parts = max(1, math.ceil(rows.count() / size))
    return rows.withColumn("part", F.pmod(F.xxhash64(F.lit(seed), "id", "v"), F.lit(parts)).cast("int")), parts


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best rows. Both inputs: id long, v array of long."""
    vectors = materialize(vectors.dropDuplicates(["id", "v"]), "vectors")
    width = vectors.agg(F.coalesce(F.max(F.size("v")), F.lit(0)).alias("n")).first()["n"]
    shards, n_shards = _parts(vectors, SHARD_ROWS, 1)
    queries = queries.dropDuplicates(["id", "v"]).withColumn("bar", F.lit(-_LONG - 1))
    blocks, n_blocks = _parts(queries, BLOCK_QUERIES, 2)
    groups = math.ceil(n_shards / GROUP_SHARDS)

    def tree(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        made = build(rows.column("id").to_numpy(), matrix(rows.column("v").combine_chunks(), width))
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "tree": pa.array([dump(**made)], pa.binary())})

    def block(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        made = dump(ids=rows.column("id").to_numpy(), vectors=matrix(rows.column("v").combine_chunks(), width), bars=rows.column("bar").to_numpy())
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "queries": pa.array([made], pa.binary())})

    def meet(key: tuple[pa.Scalar, ...], some: pa.Table, trees: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        for blob in some.column("queries"):
            asked = load(blob.as_py())
            best: list[list[tuple[int, int]]] = [[] for _ in asked["ids"]]
            for t in trees.sort_by("part").column("tree"):
                search(load(t.as_py()), asked["ids"], asked["vectors"], k, best, asked["bars"])
            out += [(q, -minus, max(-_LONG - 1, min(_LONG, score))) for q, found in zip(asked["ids"].tolist(), best, strict=True) for score, minus in found]
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else ([], [], []))], names=["query_id", "vec_id", "score"])

    trees = materialize(shards.groupBy("part").applyInArrow(tree, "part int, tree binary").withColumn("group", (F.col("part") / GROUP_SHARDS).cast("int")), "trees")

    def against(some: DataFrame, first: int, last: int) -> DataFrame:
        """What the groups from the first to the last one give to the queries."""
        asked = materialize(some.groupBy("part").applyInArrow(block, "block int, queries binary"), "queries")
        left = asked.withColumn("group", F.explode(F.sequence(F.lit(first), F.lit(last))))
        right = trees.where(F.col("group").between(first, last)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
        return left.groupBy("block", "group").cogroup(right.groupBy("block", "group")).applyInArrow(meet, "query_id long, vec_id long, score long")

    found = against(blocks, 0, 0)
    if groups > 1:
        # The k-th score in the first group bounds the k-th of all from below; the other groups start from it. Ties with it still count.
        found = materialize(found, "first")
        kth = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") >= k)
        barred = blocks.drop("bar").join(kth.select(F.col("query_id").alias("id"), F.col("kth").alias("bar")), "id", "left").withColumn("bar", F.coalesce("bar", F.lit(-_LONG - 1)))
        found = found.unionByName(against(barred, 1, groups - 1))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1(spark, sf_dir: str) -> DataFrame:
    """The 10 best rows of every row of embeddings whose vec_id is divisible by 100."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    rows = rows.select(F.col("vec_id").cast("long").alias("id"), fixed_point(F.col("embedding")).alias("v"))
    return top_k(rows, rows.where("id % 100 = 0"), 10)


OP1_SQL = """
WITH v AS (
  SELECT DISTINCT CAST(vec_id AS BIGINT) AS id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.id AS query_id, c.id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.id <> c.id WHERE q.id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

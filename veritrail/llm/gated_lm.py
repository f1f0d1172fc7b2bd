"""Scoring by a gated recurrent language model, trained by truncated backpropagation in numpy, with class-factored output.

Counts of all training words give the vocabulary. The most frequent ``HEAD`` tokens are words of their own; every other word falls into one of
``TAIL`` cells, by a hash of its last two characters, where it has its share of the cell's counts (each word's count plus one half, and
one half for all unseen words together). Words and cells form classes of ``CLASS``. The probability of a token is that of its class, given
the state, times that of the word or cell in its class, given the state, times its share in the cell; so each text's score is the log of a proper
distribution.

Texts are read twice, once for the counts and once to write their tokens as numbers, with what the counts give to both scores. Training
documents are dealt to blocks of about ``BLOCK_TOKENS`` tokens by a hash of the document, and blocks to ``ROUNDS`` rounds. In each round every
block trains a copy of the round's model, over ``LANES`` lanes of the block's documents put end to end, in windows of ``WINDOW`` tokens,
the state carried from window to window and begun anew with each document; the copies' average, weighted by tokens, is the next
round's model. So the model depends on the documents alone, not on their order, files or partitions; every training document is
trained on once, and only sums of copies travel. Scoring carries the state through the whole document. The ``KNOWN`` most frequent words
are sent to the workers; the other words' counts are joined to their occurrences instead, so nothing that grows with the corpus is
broadcast and every count is exact.

Null and empty texts have the end token only. Very long texts are trained on and scored whole. Rows with a null doc_id are not held out. Repeated rows train and score as often as they occur. Extra columns
take no part. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialize, slices

HEAD, CLASS, TAIL = 512, 32, 1024
HIDDEN, WINDOW, LANES = 16, 24, 192
#: Documents that are scored side by side.
SCORE_LANES = 1024
#: Tokens of a training block, at most but for one long document; a small corpus has a block for each round.
BLOCK_TOKENS, ROUNDS = 1 << 19, 8
KNOWN = 1 << 18
#: Distinct words that a task counts before it passes them on.
FLUSH = 1_000_000
END = 0
START = HEAD + TAIL
RATE = 0.03
_LOG10 = math.log(10)


def word_lists(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, lower-cased in A-Z, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, offsets = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    there = pc.greater(pc.binary_length(flat), 0)
    before = np.concatenate([[0], np.cumsum(there.to_numpy(zero_copy_only=False))])
    return flat.filter(there), np.diff(before[offsets])


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 1, F.lit(False))


def cell(word: str) -> int:
    """The id of the cell of a word that is none of the head."""
    return HEAD + zlib.crc32(word[-2:].encode()) % TAIL


class Network:
    """Gated recurrent unit over token ids: the words of the head, then the cells, then the start, which is an input only."""

    names = ("x", "u", "c", "cb", "w", "wb")

    def __init__(self, weights: dict[str, np.ndarray]):
        self.p = weights

    @classmethod
    def start(cls, token_counts: np.ndarray, seed: int = 6) -> Network:
        """Small random inner weights; output biases at the classes' and words' own frequencies. token_counts: by head id, then by cell."""
        rng, counts = np.random.default_rng(seed), token_counts.reshape(-1, CLASS) + 0.5
        small = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
        of_class, classes = counts.sum(axis=1), len(counts)
        return cls({"x": small(START + 1, 3 * HIDDEN), "u": small(HIDDEN, 3 * HIDDEN), "c": small(HIDDEN, classes), "cb": np.log(of_class / of_class.sum()).astype(np.float32), "w": small(classes, HIDDEN, CLASS), "wb": np.log(counts / of_class[:, None]).astype(np.float32)})

    def step(self, a: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """The next state, from inputs looked up already and the state before."""
        g = h @ self.p["u"]
        gates = np.tanh((a[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN]) * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)
        z, r, gn = gates[:, :HIDDEN], gates[:, HIDDEN:], g[:, 2 * HIDDEN :]
        n = np.tanh(a[:, 2 * HIDDEN :] + r * gn)
        return n + z * (h - n), z, r, n, gn

    def output(self, hs: np.ndarray, targets: np.ndarray, grads: dict[str, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log probability of each target's class and of the word or cell within it; with grads, the loss gradient of hs."""
        k = targets // CLASS
        logits = hs @ self.p["c"] + self.p["cb"]
        e = np.exp(logits)
        total = e.sum(axis=1)
        rows = np.arange(len(k))
        out = logits[rows, k] - np.log(total)
        dh = None
        if grads is not None:
            e /= total[:, None]
            e[rows, k] -= 1
            grads["c"] += hs.T @ e
            grads["cb"] += e.sum(axis=0)
            dh = e @ self.p["c"].T
        order = np.argsort(k, kind="stable")
        sorted_hs, at = hs[order], (targets - k * CLASS)[order]
        inner = np.empty((len(k), CLASS), hs.dtype)
        cuts = np.searchsorted(k[order], np.arange(len(self.p["w"]) + 1)).tolist()
        spans = [(c, a, z) for c, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < z]
        for c, a, z in spans:
            np.matmul(sorted_hs[a:z], self.p["w"][c], out=inner[a:z])
            inner[a:z] += self.p["wb"][c]
        e = np.exp(inner)
        total = e.sum(axis=1)
        out[order] += inner[rows, at] - np.log(total)
        if grads is not None:
            e /= total[:, None]
            e[rows, at] -= 1
            back = np.empty_like(sorted_hs)
            for c, a, z in spans:
                grads["w"][c] += sorted_hs[a:z].T @ e[a:z]
                grads["wb"][c] += e[a:z].sum(axis=0)
                np.matmul(e[a:z], self.p["w"][c].T, out=back[a:z])
            dh[order] += back
        return out, dh

    def run(self, docs: list[np.ndarray]) -> np.ndarray:
        """Sum of output() over each document, its state carried from window to window."""
        order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
        sums = np.zeros(len(docs))
        for at in range(0, len(order), SCORE_LANES):
            lanes = order[at : at + SCORE_LANES]
            lengths = np.array([len(docs[i]) for i in lanes])
            flat = np.concatenate([docs[i] for i in lanes]).astype(np.int64)
            first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            h = np.zeros((len(lanes), HIDDEN), self.p["x"].dtype)
            previous = np.full(len(lanes), START)
            live = np.searchsorted(-lengths, -np.arange(lengths[0] + 1), "left")  # live[t]: lanes longer than t
            got = np.zeros(len(lanes))
            for t0 in range(0, int(lengths[0]), WINDOW):
                hs, targets = [], []
                for t in range(t0, min(t0 + WINDOW, int(lengths[0]))):
                    n = int(live[t])
                    h = self.step(self.p["x"][previous[:n]], h[:n])[0]
                    hs.append(h)
                    previous = flat[first[:n] + t]
                    targets.append(previous)
                out, _ = self.output(np.concatenate(hs), np.concatenate(targets))
                got += np.bincount(np.concatenate([np.arange(len(x)) for x in targets]), out, len(lanes))
            sums[lanes] = got
        return sums

    def learn(self, stream: np.ndarray, adam: Adam, lanes: int | None = None) -> None:
        """Trains on documents put end to end, each with its end token, cut into lanes of equal length; the weights move after each window."""
        n = len(stream)
        lanes = min(LANES, max(1, n // (8 * WINDOW))) if lanes is None else lanes
        length = -(-n // lanes)
        targets = np.zeros(lanes * length, np.int64)
        targets[:n] = stream
        inputs = np.concatenate([[END], targets[:-1]])
        inputs[inputs == END] = START
        counts = (np.arange(lanes * length) < n).reshape(lanes, length).T
        inputs, targets = (np.ascontiguousarray(x.reshape(lanes, length).T) for x in (inputs, targets))
        h = np.zeros((lanes, HIDDEN), self.p["x"].dtype)
        for t0 in range(0, length, WINDOW):
            some, aims, real = inputs[t0 : t0 + WINDOW], targets[t0 : t0 + WINDOW], counts[t0 : t0 + WINDOW]
            a, keep = self.p["x"][some], (some != START)[:, :, None].astype(self.p["x"].dtype)
            kept, hs = [], []
            for t in range(len(some)):
                before = h * keep[t]
                h, *gates = self.step(a[t], before)
                kept.append((before, *gates))
                hs.append(h)
            grads = {k: np.zeros_like(v) for k, v in self.p.items()}
            live = real.ravel()
            all_hs, dh = np.concatenate(hs), None
            if live.all():
                _, dh = self.output(all_hs, aims.ravel(), grads)
            elif live.any():  # the last lane may be shorter
                dh = np.zeros_like(all_hs)
                dh[live] = self.output(all_hs[live], aims.ravel()[live], grads)[1]
            if dh is not None:
                self.back(some, keep, kept, dh.reshape(len(some), lanes, HIDDEN), grads)
                adam.step(self.p, grads, int(live.sum()))

    def back(self, some: np.ndarray, keep: np.ndarray, kept: list[tuple], dh: np.ndarray, grads: dict[str, np.ndarray]) -> None:
        """Backpropagation through the steps of one window, not across the beginning of a document."""
        carried, u = np.zeros_like(dh[0]), self.p["u"]
        da = np.empty((*some.shape, 3 * HIDDEN), dh.dtype)
        for t in range(len(some) - 1, -1, -1):
            before, z, r, n, gn = kept[t]
            d = dh[t] + carried
            dn = d * (1 - z) * (1 - n * n)
            dg = np.empty((len(d), 3 * HIDDEN), dh.dtype)
            dg[:, :HIDDEN] = d * (before - n) * z * (1 - z)
            dg[:, HIDDEN : 2 * HIDDEN] = dn * gn * r * (1 - r)
            da[t] = dg
            da[t, :, 2 * HIDDEN :] = dn
            dg[:, 2 * HIDDEN :] = dn * r
            grads["u"] += before.T @ dg
            carried = (d * z + dg @ u.T) * keep[t]
        ids, da = some.ravel(), da.reshape(-1, 3 * HIDDEN)
        order = np.argsort(ids, kind="stable")
        cuts = np.flatnonzero(np.diff(ids[order], prepend=-1))
        grads["x"][ids[order][cuts]] += np.add.reduceat(da[order], cuts, axis=0)


class Adam:
    """Adam on the mean gradient of a window; rates fall with the windows seen, begun with those of earlier rounds."""

    def __init__(self, rate: float = RATE, before: int = 0):
        self.rate, self.before, self.t, self.m, self.v = rate, before, 0, {}, {}

    def step(self, p: dict[str, np.ndarray], grads: dict[str, np.ndarray], n: int) -> None:
        self.t += 1
        rate = np.float32(self.rate * math.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t) / math.sqrt(1 + (self.before + self.t) / 50))
        for k, g in grads.items():
            g = g / np.float32(n)
            m = self.m[k] = self.m.get(k, 0) * np.float32(0.9) + g * np.float32(0.1)
            v = self.v[k] = self.v.get(k, 0) * np.float32(0.999) + g * g * np.float32(0.001)
            p[k] -= rate * m / (np.sqrt(v) + np.float32(1e-8))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))


def count_words(docs: DataFrame) -> DataFrame:
    """word and c, over the training documents; the end token is counted apart."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rows = [], 0
        for b in slices(batches, 2048, 8 << 20):
            words, _ = word_lists(b.column(1).filter(pc.invert(b.column(0))))
            counted = words.value_counts()
            parts.append(pa.table([counted.field(0), counted.field(1)], names=["word", "c"]))
            rows += len(counted)
            if rows > FLUSH:
                parts = [pa.concat_tables(parts).group_by("word").aggregate([("c", "sum")]).rename_columns(["word", "c"])]
                if (rows := len(parts[0])) > FLUSH // 2:
                    yield from parts[0].to_batches(50_000)
                    parts, rows = [], 0
        if rows:
            yield from pa.concat_tables(parts).group_by("word").aggregate([("c", "sum")]).rename_columns(["word", "c"]).to_batches(50_000)

    return docs.select("held_out", "text").mapInArrow(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """The most frequent words: their counts and their ids as the network has them. ends: training documents; z: mass of the tail classes."""

    def __init__(self, known: list[tuple[str, int]], ends: int, n: int, v: int, z: np.ndarray):
        self.n, self.v, self.ends = n, v, ends
        self.index = {w: i for i, (w, _) in enumerate(known)}
        self.counts = np.array([c for _, c in known] + [0], np.int64)  # the last stands for words that are not known
        self.ids = np.array([i + 1 if i < HEAD - 1 else cell(w) for i, (w, _) in enumerate(known)] + [-1], np.int64)
        self.z = z

    def read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """Words of each text, the place of each word (-1: not known), its id in the network, and all words."""
        flat, n = word_lists(texts)
        coded = flat.dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        at = np.fromiter(map(self.index.get, words, [-1] * len(words)), np.int64, len(words))
        ids = self.ids[at]
        rest = np.flatnonzero(at < 0).tolist()
        ids[rest] = [cell(words[i]) for i in rest]
        which = coded.indices.to_numpy()
        return n, at[which], ids[which], flat


_TOKENS = np.dtype("<u2")


def encode(docs: DataFrame, words) -> DataFrame:
    """Per document its tokens as 16-bit numbers, and what the counts of known words give to both scores. words: a broadcast Vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = words.value
        log_c, log_z, base_z = np.log10(vocab.counts + 0.5), np.log10(vocab.z), math.log10(vocab.n + 0.5 * (vocab.v + 1))
        log_c[-1] = 0
        end = math.log10(vocab.ends + 0.5)
        for b in slices(batches, 2048, 8 << 20):
            n, at, ids, flat = vocab.read(b.column(2))
            rows, doc = len(n), np.repeat(np.arange(len(n)), n)
            total = lambda x, doc=doc, rows=rows: np.bincount(doc, x, rows) if len(doc) else np.zeros(rows)
            logs, tail = total(log_c[at]), ids >= HEAD
            in_class = total(np.where(tail, log_c[at] - log_z[np.where(tail, ids - HEAD, 0)], 0.0))
            ends = np.cumsum(n + 1)
            tokens = np.full(int(ends[-1]), END, _TOKENS)
            tokens[np.arange(len(ids)) + doc] = ids
            blobs = pa.Array.from_buffers(pa.large_binary(), rows, [None, pa.py_buffer(np.concatenate([[0], 2 * ends]).astype(np.int64)), pa.py_buffer(tokens)]).cast(pa.binary())
            other = at < 0
            others = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(total(other))]), pa.int32()), flat.filter(pa.array(other)))
            columns = [b.column(0), b.column(1), pa.array(n + 1), pa.array(total(~other).astype(np.int64) + (vocab.ends > 0)), pa.array(logs + end - (n + 1) * base_z), pa.array(in_class), others, blobs]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "in_class", "others", "tokens"]
    return docs.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, in_class double, others array<string>, tokens binary")


def _pack(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in Network.names])


def _unpack(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    at, out = 0, {}
    for k in Network.names:
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def blocks_of(encoded: DataFrame, block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, int]:
    """round, block and its documents in an order of their own; and the number of blocks.

    A document's block comes from a hash of it. Rows equal in id and text are counted before they move, and dealt over the blocks from there on.
    """
    rows = encoded.where("NOT held_out").select("tokens", "n_tokens", F.xxhash64(F.lit(6), "doc_id", "tokens").alias("h"))
    n = max(ROUNDS, math.ceil((rows.agg(F.sum("n_tokens")).first()[0] or 0) / block_tokens))
    repeated = materialize(rows.groupBy("h").agg(F.count("*").alias("m")).where("m > 1").select("h"), "repeated")
    once = rows.join(repeated, "h", "left_anti").select("h", "tokens", F.lit(1).alias("times"), F.lit(0).alias("k"))
    several = rows.join(repeated, "h", "left_semi").groupBy("h", "tokens").agg(F.count("*").alias("m"))
    several = several.select("h", "tokens", "m", F.explode(F.sequence(F.lit(0), F.least("m", F.lit(n)).cast("int") - 1)).alias("k"))
    several = several.select("h", "tokens", F.ceil((F.col("m") - F.col("k")) / n).cast("int").alias("times"), "k")
    rows = once.unionByName(several).withColumn("block", F.pmod(F.pmod("h", F.lit(n)) + F.col("k"), F.lit(n)).cast("int"))
    rows = rows.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("h", "tokens", "times"))).alias("d"))
    rows = rows.select("block", F.flatten(F.transform("d", lambda d: F.array_repeat(d["tokens"], d["times"]))).alias("docs"), (F.col("block") % ROUNDS).alias("round"))
    return materialize(rows, "blocks", "round"), n


def train(encoded: DataFrame, net: Network) -> Network:
    """The model after all rounds."""
    blocks, n = blocks_of(encoded)
    slots, windows = encoded.sparkSession.sparkContext.defaultParallelism, 0

    def plus(rows: pa.Table) -> pa.Table:
        sums = np.sum([np.frombuffer(x.as_py()) for x in rows.column("w")], axis=0)
        return pa.table({"n": pa.array([pc.sum(rows.column("n")).as_py()], pa.int64()), "w": pa.array([sums.tobytes()], pa.binary()), "windows": pa.array([pc.max(rows.column("windows")).as_py()], pa.int64())})

    for k in range(ROUNDS):
        weights, before = net.p, windows

        def copies(batches: Iterator[pa.RecordBatch], weights=weights, before=before) -> Iterator[pa.RecordBatch]:
            sums, n, most = 0.0, 0, 0
            for b in slices(batches, 1):
                stream = np.frombuffer(b"".join(x.as_py() for x in b.column(0)[0].values), _TOKENS)
                one, adam = Network({k: v.copy() for k, v in weights.items()}), Adam(before=before)
                one.learn(stream, adam)
                sums, n, most = sums + len(stream) * _pack(one.p).astype(np.float64), n + len(stream), max(most, adam.t)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n], pa.int64()), pa.array([sums.tobytes()], pa.binary()), pa.array([most], pa.int64())], ["task", "n", "w", "windows"])

        tasks = max(1, min(2 * slots, -(-n // ROUNDS)))
        part = blocks.where(F.col("round") == k).select("docs").repartition(tasks).mapInArrow(copies, "task int, n long, w binary, windows long")
        groups = max(1, math.isqrt(tasks))
        got = part.groupBy((F.col("task") % groups).alias("g")).applyInArrow(lambda t: plus(t.select(["n", "w", "windows"])), "n long, w binary, windows long").collect()  # one row a group
        if got:
            windows += max(r["windows"] for r in got)
            net = Network(_unpack(np.sum([np.frombuffer(r["w"]) for r in got], axis=0) / sum(r["n"] for r in got), weights))
    return net


def vocabulary(docs: DataFrame, known: int = KNOWN) -> tuple[Vocabulary, DataFrame, np.ndarray]:
    """The vocabulary, all counts (word, c), and the counts of head ids and tail classes."""
    counts = materialize(count_words(docs), "counts")
    ends = docs.where("NOT held_out").count()
    # The least count such that no more than ``known`` words have it or more, to an eighth of a doubling: 512 steps at most.
    step, least, n = F.floor(8 * F.log2("c")).cast("int"), 0, 0
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), reverse=True):
        if n + r["n"] > known:
            least = r["step"] + 1
            break
        n += r["n"]
    top = sorted(((r["word"], r["c"]) for r in counts.where(step >= least).collect()), key=lambda x: (-x[1], x[0]))
    ends_and = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    head = [w for w, _ in top[: HEAD - 1]]
    cells = F.pmod(F.crc32(F.expr("right(word, 2)")), F.lit(TAIL)).cast("int")
    rest = counts.where(~F.col("word").isin(head)) if head else counts
    tails = {r["k"]: (r["c"], r["v"]) for r in rest.groupBy(cells.alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()}
    c, v = (np.array([tails.get(k, (0, 0))[i] for k in range(TAIL)], float) for i in (0, 1))
    by_id = np.zeros(HEAD + TAIL)
    by_id[END] = ends
    by_id[1 : 1 + len(head)] = [n for _, n in top[: HEAD - 1]]
    by_id[HEAD:] = c
    return Vocabulary(top, ends, ends_and["n"] + ends, ends_and["v"] + (ends > 0), c + 0.5 * v + 0.5), counts, by_id


def _batched(batches: Iterator[pa.RecordBatch], most: int = 8 << 20) -> Iterator[list[pa.RecordBatch]]:
    """Batches in lists of about so many bytes of tokens, so that long documents run side by side."""
    some, size = [], 0
    for b in slices(batches, 4096):
        some.append(b)
        size += b.nbytes
        if size > 2 * most:
            yield some
            some, size = [], 0
    if some:
        yield some


def score(docs: DataFrame, known: int = KNOWN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark, docs = docs.sparkSession, _texts(docs)
    vocab, counts, by_id = vocabulary(docs, known)
    words = spark.sparkContext.broadcast(vocab)  # at most ``known`` words
    encoded = materialize(encode(docs, words).withColumn("row", F.monotonically_increasing_id()), "encoded")
    weights = train(encoded, Network.start(by_id)).p

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(weights)
        for some in _batched(batches):
            t = pa.Table.from_batches(some)
            logs = net.run([np.frombuffer(x.as_py(), _TOKENS) for x in t.column("tokens")]) / _LOG10
            t = t.drop_columns(["tokens", "in_class"]).append_column("score", pa.array(logs + t.column("in_class").to_numpy()))
            yield from t.select(names).to_batches()

    names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
    part = encoded.drop("others").mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    # Words beyond the known ones: their counts come by a join, and enter both scores in the same way.
    other = encoded.select("row", F.explode("others").alias("word")).join(counts, "word", "left")
    other = other.groupBy("row").agg(F.count("c").alias("more"), F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("logs"))
    out = part.join(other, "row", "left")
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(vocab.n).cast("long").alias("train_tokens"), *[(F.col(s) + F.coalesce("logs", F.lit(0.0))).alias(s) for s in ("base_score", "score")])


def op6(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of those that are not held out."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Toxicity by a weighted finite-state pattern grammar.

A text is cut into clauses, and each clause is read by one machine, the composition of seven weighted transducers: the lexicon reads a
word's letters and writes insult, threat, target, negation, report, modal or other, with the word's weight; negation marks insults and
threats in its scope; reported speech those after a verb of speaking; threat lets a verb of violence count after a modal or as an imperative
at the head of the clause; insult tells what was marked apart; target reads each clause twice, as one that addresses someone, which is accepted
only if a target word occurs, and as one that does not, in which no threat counts; outcome adds the weight of the pattern that a marked
word ended in. Weights add along a path, the best accepted path's is the clause's score, and no word has a score outside a
pattern: the lexicon may read any word as plain, so a word whose pattern takes away more than the word brings adds nothing.

What is learned, from labelled rows only: the insult lexicon (words and word beginnings whose document frequencies tell the labels apart
beyond chance), the patterns' weights (log likelihood ratios of documents that show them, from prior ones with pseudo-counts: an insult
that addresses no one counts for little unless the labels teach otherwise) and how the clauses' sum becomes a probability (logistic regression
held near a prior). All use at most ``TRAIN_ROWS`` labelled rows of each label, by smallest hash; rows that are near copies of another one, by
their shingles in full, count once. Lexicon and patterns are judged by shares within each label and the regression weights a sampled
row by the rows it stands for, so neither depends on how far a label was thinned. All texts are scored whole.

Null and empty texts have no clause and get the score of a text without one. Very long texts are read clause by clause. Labels that are null take no part; a doc_id labelled twice
counts by its higher label. With no labels the fixed seeds and priors remain. Repeated rows get equal scores, as a score depends on the
text alone. Extra columns take no part. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialize, slices

#: Labelled rows of each label that a model may be fitted on.
TRAIN_ROWS = 20_000
#: Times that a lexicon entry must be more frequent among toxic rows than among clean ones, whatever the numbers of both.
RATIO = 11
STEMS = (3, 4, 5, 6, 7)
#: Documents that a pattern's prior weight counts for.
PATTERN_PRIOR = 8
#: Rows of the sample with one least shingle that are compared with the first of them in one task.
SAME_KEY = 64
#: First rows of a key that each of its other rows is compared with.
ROUNDS = 2
#: Words whose reading a worker keeps.
CACHE = 400_000

# Seed words of the lexicon.
SEED_INSULTS = "idiot idiots moron morons imbecile scumbag dumbass bastard bastards retard loser losers".split()
THREATS = "kill hurt destroy murder shoot stab strangle".split()
TARGETS = "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi vous votre tú ti usted vosotros".split()
NEGATIONS = "not never isn't aren't wasn't don't doesn't nicht kein keine nie pas jamais nunca".split()
REPORTS = "said says claimed wrote called reported quoted sagte schrieb nannte disait dijo escribió".split()
MODALS = "will shall gonna must should".split()
SEED_WEIGHT, THREAT_WEIGHT = 2.0, 1.0

# What the lexicon writes, what the machines in the middle write in its place, and the patterns that words end in.
PLAIN, NEGATION, REPORT, MODAL, TARGET, INSULT, THREAT = range(7)
IMPERATIVE, NEG_INSULT, NEG_THREAT, REP_INSULT, REP_THREAT = range(7, 12)
PATTERNS = ("insult", "insult_target", "insult_negated", "insult_reported", "threat_target", "imperative_target", "threat_negated", "threat_reported")
SYMBOLS = 12 + len(PATTERNS)
_OF = {name: 12 + i for i, name in enumerate(PATTERNS)}
#: Weights of the patterns before any label is seen.
PATTERN_WEIGHTS = {"insult": -3.0, "insult_target": 1.5, "insult_negated": -5.0, "insult_reported": -4.0, "threat_target": 2.0, "imperative_target": 2.0, "threat_negated": -5.0, "threat_reported": -4.0}
#: Bias, weight of the clauses' sum, and of the sum for each hundred words, both by log1p.
PRIOR = np.array([-3.5, 1.0, 0.5])
NEGATION_SCOPE, MODAL_SCOPE = 4, 3

WORDS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
CLAUSES = re.compile(r"[.!?;:\n]+")

Arc = tuple[int, int, float]


@dataclass(frozen=True)
class Transducer:
    """arcs[state][symbol]: (next state, symbol out, weight) of each way to read the symbol; finals: weights of accepting states; state 0 starts."""

    arcs: tuple[tuple[tuple[Arc, ...], ...], ...]
    finals: dict[int, float]

    def best(self, readings: list[tuple[tuple[int, float], ...]]) -> tuple[float, tuple[int, ...]]:
        """Weight and output of the best accepted path over words that have one or more readings (symbol, weight) each."""
        live: dict[int, tuple[float, tuple]] = {0: (0.0, ())}
        for ways in readings:
            following: dict[int, tuple[float, tuple]] = {}
            for state, (total, back) in live.items():
                for symbol, own in ways:
                    for to, out, weight in self.arcs[state][symbol]:
                        sum_ = total + own + weight
                        if to not in following or sum_ > following[to][0]:
                            following[to] = sum_, (out, back)
            live = following
        total, back = max(((t + self.finals[s], b) for s, (t, b) in live.items() if s in self.finals), key=lambda x: x[0], default=(-math.inf, ()))
        out = []
        while back:
            out.append(back[0])
            back = back[1]
        return total, tuple(out[::-1])


def compose(a: Transducer, b: Transducer) -> Transducer:
    """a, then b on what a writes; weights add. States are pairs that can be reached."""
    index, todo, arcs = {(0, 0): 0}, [(0, 0)], []

    def state(pair: tuple[int, int]) -> int:
        if pair not in index:
            index[pair] = len(index)
            todo.append(pair)
        return index[pair]

    for p, q in todo:
        arcs.append(tuple(tuple((state((p2, q2)), out2, w + w2) for p2, out, w in ways for q2, out2, w2 in b.arcs[q][out]) for ways in a.arcs[p]))
    return Transducer(tuple(arcs), {i: a.finals[p] + b.finals[q] for (p, q), i in index.items() if p in a.finals and q in b.finals})


def _machine(states: int, step, finals: dict[int, float] | None = None) -> Transducer:
    """step(state, symbol) gives the arcs."""
    return Transducer(tuple(tuple(tuple(step(s, x)) for x in range(SYMBOLS)) for s in range(states)), dict.fromkeys(range(states), 0.0) if finals is None else finals)


def negation() -> Transducer:
    def step(s: int, x: int) -> Iterator[Arc]:
        yield (NEGATION_SCOPE, x, 0.0) if x == NEGATION else (max(0, s - 1), {INSULT: NEG_INSULT, THREAT: NEG_THREAT}.get(x, x) if s else x, 0.0)

    return _machine(NEGATION_SCOPE + 1, step)


def reported_speech() -> Transducer:
    def step(s: int, x: int) -> Iterator[Arc]:
        yield (1 if x == REPORT else s), {INSULT: REP_INSULT, THREAT: REP_THREAT}.get(x, x) if s else x, 0.0

    return _machine(2, step)


def threat() -> Transducer:
    """A verb of violence stands for a threat soon after a modal or, where it opens the clause (state 0), as an imperative; else only its plain reading passes."""

    def step(s: int, x: int) -> Iterator[Arc]:
        if x == MODAL:
            yield MODAL_SCOPE + 1, x, 0.0
        elif x not in (THREAT, NEG_THREAT, REP_THREAT) or s > 1:
            yield max(1, s - 1), x, 0.0
        elif s == 0 and x == THREAT:
            yield 1, IMPERATIVE, 0.0

    return _machine(MODAL_SCOPE + 2, step)


def insult() -> Transducer:
    """Insults that were marked become patterns; a bare one is left to the target machine."""

    def step(s: int, x: int) -> Iterator[Arc]:
        yield s, {NEG_INSULT: _OF["insult_negated"], REP_INSULT: _OF["insult_reported"], NEG_THREAT: _OF["threat_negated"], REP_THREAT: _OF["threat_reported"]}.get(x, x), 0.0

    return _machine(1, step)


def target() -> Transducer:
    """From state 0, the clause addresses someone (1 until the target occurs, then 2) or no one (3), where no threat passes. Only 2 and 3 accept."""
    aimed = {INSULT: _OF["insult_target"], THREAT: _OF["threat_target"], IMPERATIVE: _OF["imperative_target"]}

    def step(s: int, x: int) -> Iterator[Arc]:
        if s < 3:
            yield (2 if x == TARGET or s == 2 else 1), aimed.get(x, x), 0.0
        if s in (0, 3) and x not in (THREAT, IMPERATIVE):
            yield 3, _OF["insult"] if x == INSULT else x, 0.0

    return _machine(4, step, {0: 0.0, 2: 0.0, 3: 0.0})


def outcome(weights: dict[str, float]) -> Transducer:
    by = {_OF[k]: w for k, w in weights.items()}
    return _machine(1, lambda s, x: iter([(s, x, by.get(x, 0.0))]))


_PATTERN_GRAMMAR = compose(compose(compose(compose(negation(), reported_speech()), threat()), insult()), target())


def grammar(weights: dict[str, float]) -> Transducer:
    return compose(_PATTERN_GRAMMAR, outcome(weights))


class Lexicon:
    """A transducer over letters: a tree of the entries, each with its class and weight where it ends, or where its beginning (a stem) does."""

    def __init__(self, words: dict[str, tuple[int, float]], stems: dict[str, tuple[int, float]]):
        self.arcs: list[dict[str, int]] = [{}]
        self.ends: dict[int, tuple[int, float]] = {}
        self.opens: dict[int, tuple[int, float]] = {}
        for entries, at_end in ((words, self.ends), (stems, self.opens)):
            for entry, what in entries.items():
                state = 0
                for c in entry:
                    if c not in self.arcs[state]:
                        self.arcs.append({})
                        self.arcs[state][c] = len(self.arcs) - 1
                    state = self.arcs[state][c]
                at_end[state] = what

    def read(self, word: str) -> tuple[tuple[int, float], ...]:
        """The word's readings; one that may be an insult or a threat can be read as plain as well."""
        state, found = 0, None
        for c in word:
            if (x := self.opens.get(state)) and (found is None or x[1] > found[1]):
                found = x  # a stem is the beginning of a longer word, as it was counted
            state = self.arcs[state].get(c, -1)
            if state < 0:
                break
        if state >= 0 and (x := self.ends.get(state)) and (found is None or x[0] not in (INSULT, PLAIN) or x[1] > found[1]):
            found = x
        if found is None:
            return _PLAIN
        return (found, _PLAIN[0]) if found[0] in (INSULT, THREAT) else (found,)


_PLAIN = ((PLAIN, 0.0),)


@dataclass
class Model:
    """words and stems: weights of learned insults; patterns: as PATTERN_WEIGHTS; weights: as PRIOR."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    patterns: dict[str, float] = field(default_factory=lambda: dict(PATTERN_WEIGHTS))
    weights: np.ndarray = field(default_factory=lambda: PRIOR.copy())

    def __post_init__(self):
        fixed = {w: (k, 0.0) for k, ws in ((NEGATION, NEGATIONS), (REPORT, REPORTS), (MODAL, MODALS), (TARGET, TARGETS)) for w in ws}
        fixed |= dict.fromkeys(THREATS, (THREAT, THREAT_WEIGHT)) | dict.fromkeys(SEED_INSULTS, (INSULT, SEED_WEIGHT))
        self.lexicon = Lexicon(fixed | {w: (INSULT, x) for w, x in self.words.items()}, {w: (INSULT, x) for w, x in self.stems.items()})
        self.machine = grammar(self.patterns)
        self.known: dict[str, tuple[tuple[int, float], ...]] = {}

    def read(self, words: set[str]) -> bool:
        """Makes the words known; whether one of them may be an insult or a threat."""
        known = self.known
        if len(known) > CACHE:
            known.clear()
        for w in words.difference(known):
            known[w] = self.lexicon.read(w)
        return any(len(known[w]) > 1 for w in words)

    def clause(self, words: list[str]) -> tuple[float, tuple[int, ...]]:
        """The clause's score and what its words ended in."""
        self.read(set(words))
        return self.machine.best([self.known[w] for w in words])

    def clauses(self, text: str) -> tuple[float, Counter[int], int]:
        """Sum of the clauses' scores, the patterns found, and the number of words (0 where nothing is found)."""
        text, total, found = text.lower(), 0.0, Counter()
        words = WORDS.findall(text)
        if not self.read(set(words)):
            return 0.0, found, 0
        for clause in CLAUSES.split(text):
            some = WORDS.findall(clause)
            if any(len(self.known[w]) > 1 for w in some):
                score, out = self.machine.best([self.known[w] for w in some])
                total += score
                found.update(x for x in out if x >= 12)
        return total, found, len(words)

    def features(self, text: str) -> np.ndarray:
        """The sum, and the sum for each hundred words, on a scale on which each further one counts less."""
        total, _, n = self.clauses(text)
        return np.log1p([total, 100 * total / max(1, n)])

    def score(self, text: str) -> float:
        total, _, n = self.clauses(text)
        z = float(self.weights[0])
        if total > 0:
            z += float(self.weights[1]) * math.log1p(total) + float(self.weights[2]) * math.log1p(100 * total / n)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5)) == 0, F.lit(False))


def labelled(labels: DataFrame) -> DataFrame:
    """doc_id and toxic of each labelled document that is not held out."""
    return labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))


def stands_for(labels: DataFrame, rows: int) -> dict[int, float]:
    """By label, the labelled documents that each one of a sample of at most so many stands for."""
    return {r["toxic"]: max(1.0, r["count"] / rows) for r in labelled(labels).groupBy("toxic").count().collect()}


def shingled(text: str) -> set[int]:
    w = WORDS.findall(text.lower())
    return {xxhash.xxh64_intdigest(" ".join(w[i : i + 5])) for i in range(max(1, len(w) - 4))}


def sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """toxic and text of at most so many labelled documents of each label, not held out.

    Rows of one label that share their least shingle are compared by all shingles with ``ROUNDS`` of them, one after the other; those of
    similarity 0.75 to one of these are left out. No row goes without that comparison, and the work stays in proportion to the rows.
    """
    known = labelled(labels)
    order = F.xxhash64(F.lit(10), "doc_id")
    some = [known.where(F.col("toxic") == k).orderBy(order, "doc_id").limit(rows) for k in (0, 1)]
    texts = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows_ = texts.join(F.broadcast(some[0].unionByName(some[1])), "doc_id").select("toxic", "text").distinct()  # the broadcast is bounded by rows

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            keys = [min(shingled(t)) >> 1 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.int64())], ["toxic", "text", "key"])

    def unlike_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            pairs = [(shingled(t), shingled(f)) if t != f else ({0}, {0}) for t, f in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield b.filter(pa.array([100 * len(x & y) < 75 * len(x | y) for x, y in pairs], pa.bool_())).select([0, 1, 2])

    left, kept = materialize(rows_.mapInArrow(keyed, "toxic int, text string, key long"), "keyed"), []
    for k in range(ROUNDS):
        # The first row of each key, in an order of its own so that a fit repeats; keys with many rows are dealt by salts.
        groups = left.groupBy("toxic", "key").agg(F.count("*").alias("n"), F.min_by("text", F.struct(F.xxhash64(F.lit(k), "text"), "text")).alias("first"))
        groups = materialize(groups.withColumn("salts", F.ceil(F.col("n") / SAME_KEY).cast("int")), "groups")
        kept.append(groups.select("toxic", F.col("first").alias("text")))
        salts = F.broadcast(groups.where("salts > 1").select("toxic", "key", "salts"))  # at most 2 * rows / SAME_KEY
        salted = left.join(salts, ["toxic", "key"], "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("text"), F.col("salts")), F.lit(0)).cast("int"))
        firsts = groups.select("toxic", "key", "first", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        rest = salted.join(firsts, ["toxic", "key", "salt"]).select("toxic", "text", "key", "first")
        left = materialize(rest.mapInArrow(unlike_first, "toxic int, text string, key long"), "left")
    return reduce(DataFrame.unionByName, [*kept, left.select("toxic", "text")])


def features_of(text: str) -> set[str]:
    """Its words, and their beginnings marked by a star."""
    out = set(WORDS.findall(text.lower()))
    return out | {w[:n] + "*" for w in list(out) for n in STEMS if len(w) > n}


def lexicon(rows: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems whose shares of the documents under the labels differ by ``RATIO`` and beyond chance, with log odds."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())
        for b in slices(batches):
            for toxic, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen[toxic].update(features_of(text))
        names = list(seen[0].keys() | seen[1].keys())
        for at in range(0, len(names), 50_000):
            some = names[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), *(pa.array([seen[k][x] for x in some], pa.int64()) for k in (0, 1))], ["x", "c", "t"])

    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 or not n1:
        return {}, {}
    sums = rows.select("toxic", "text").mapInArrow(count, "x string, c long, t long").groupBy("x").agg(F.sum("c").alias("c"), F.sum("t").alias("t"))
    q, c, t = n1 / (n0 + n1), F.col("c"), F.col("t")
    share = t / (t + c)
    gain = t * F.log(share / q) + F.when(c > 0, c * F.log((1 - share) / (1 - q))).otherwise(0)
    kept = sums.where((t >= 4) & (t * n0 > RATIO * c * n1)).withColumn("gain", gain).where(F.col("gain") > math.log(1e7))
    found = {r["x"]: min(6.0, math.log((r["t"] + 0.5) / (r["c"] + 0.5) * (n0 + 1) / (n1 + 1))) for r in kept.collect()}
    return {x: w for x, w in found.items() if x[-1] != "*" and w > 0}, {x[:-1]: w for x, w in found.items() if x[-1] == "*" and w > 0}


def regress(x: np.ndarray, y: np.ndarray, prior: np.ndarray, ridge: float = 2.0, rounds: int = 25, times: np.ndarray | None = None) -> np.ndarray:
    """Logistic regression by Newton steps, pulled toward the prior; each row counts so many times."""
    x, w, times = np.hstack([np.ones((len(x), 1)), x]), prior.copy(), np.ones(len(x)) if times is None else times
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (times * (p - y)) + ridge * (w - prior)
        w = w - np.linalg.solve((x.T * (times * p * (1 - p))) @ x + ridge * np.eye(len(w)), grad)
    return w


def pattern_weights(rows: DataFrame, model: Model) -> dict[str, float]:
    """Log likelihood ratio of the documents that show a pattern, begun with ``PATTERN_PRIOR`` documents at the prior weight."""
    seen = Model(model.words, model.stems, {k: 0.5 * (k.endswith("target")) for k in PATTERNS})  # reads every mark, and as aimed where it can

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [(k, x) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for x in [-1, *seen.clauses(t)[1]]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in zip(*found, strict=True)], ["toxic", "pattern"])

    n = {(r["toxic"], r["pattern"]): r["count"] for r in rows.select("toxic", "text").mapInArrow(count, "toxic int, pattern int").groupBy("toxic", "pattern").count().collect()}
    all_ = [n.get((k, -1), 0) for k in (0, 1)]
    out = {}
    for name, prior in PATTERN_WEIGHTS.items():
        c, t = (n.get((k, _OF[name]), 0) for k in (0, 1))
        rate = [(x + PATTERN_PRIOR * share) / (total + PATTERN_PRIOR) for x, total, share in ((c, all_[0], 1 / (1 + math.exp(prior))), (t, all_[1], 1 / (1 + math.exp(-prior))))]
        out[name] = max(-6.0, min(6.0, math.log(rate[1] / rate[0]))) if c + t else prior
    return out


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    some = materialize(sample(docs, labels, rows), "labelled")
    words, stems = lexicon(some)
    model = Model(words, stems)
    model = Model(words, stems, pattern_weights(some, model))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            xs = [model.features(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tolist() for x in xs], pa.list_(pa.float64()))], ["toxic", "x"])

    got = some.select("toxic", "text").mapInArrow(features, "toxic int, x array<double>").groupBy("toxic", "x").count().collect()  # 2 * rows at most
    if {r["toxic"] for r in got} == {0, 1}:
        each = stands_for(labels, rows)  # the sample takes the labels' rows at different rates; the fit has the ratio of all labelled rows
        x, y = np.array([r["x"] for r in got]), np.array([r["toxic"] for r in got], float)
        times = np.array([r["count"] * each[r["toxic"]] for r in got])
        order = np.lexsort([*x.T, y])
        model.weights = regress(x[order], y[order], PRIOR, times=times[order])
    return model


def scores(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score of every row."""
    kind = docs.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.score(t.as_py() or "") for t in b.column(1)], pa.float64())], [key, "score"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, score double")


def without_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows whose score is below 0.5, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            at = b.schema.get_field_index(text)
            yield b.filter(pa.array([model.score(t.as_py() or "") < 0.5 for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op10(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model fitted on the labelled rows that are not held out."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = scores(docs, fit(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

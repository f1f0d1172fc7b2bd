"""The learned operators: arithmetic against plain restatements, gradients, held-out accuracy, odd input."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritrail.llm import gated_lm as L
from veritrail.llm import quality_classifier as C
from veritrail.llm import toxicity as X

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(1, None, 1), (2, "", 1), (3, "one two one", 1), (3, "one two one", 1), (None, "two\x1cthree four", 1), (4, "é É x " * 800, 1), (12, "unseen words here two", 1)]


def base_scores(rows):
    toks = [WORD.findall((t or "").encode().lower().decode()) + [None] for _, t in rows]
    held = [d is not None and zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in rows]
    c = Counter(w for ws, h in zip(toks, held, strict=True) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    return [(h, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for ws, h in zip(toks, held, strict=True)]


@pytest.mark.parametrize("known", [1, 4, 1 << 18])
def test_base_scores(spark, known):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, row int")
    got = sorted((r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in L.score(docs, known).collect())
    assert got == sorted((*b[:4], round(b[4], 6)) for b in base_scores([r[:2] for r in ODD]))
    assert L.score(docs.limit(0)).count() == 0


def test_repeated_rows_are_dealt_over_blocks(spark):
    rows = [(1, False, bytes(range(200)) * 10, 1000)] * 3000 + [(k, False, bytes([k % 250]) * 100, 50) for k in range(2, 900)] + [(7, True, b"ab", 1)]
    encoded = spark.createDataFrame(rows, "doc_id long, held_out boolean, tokens binary, n_tokens long")
    blocks, n = L.blocks_of(encoded.repartition(5), 1 << 16)
    sizes = {r["block"]: sum(len(t) // 2 for t in r["docs"]) for r in blocks.collect()}
    assert n == 47 and len(sizes) == n and max(sizes.values()) < 2 << 16 and sum(sizes.values()) == 3000 * 1000 + 898 * 50
    again = {r["block"]: r["docs"] for r in L.blocks_of(encoded.repartition(2), 1 << 16)[0].collect()}
    assert again == {r["block"]: r["docs"] for r in blocks.collect()}
    few, n = L.blocks_of(spark.createDataFrame([(1, False, b"abcd", 2)] * 20, encoded.schema))
    assert n == L.ROUNDS and sorted(len(r["docs"]) for r in few.collect()) == [2, 2, 2, 2, 3, 3, 3, 3]


def test_scores_are_a_distribution():
    rng = np.random.default_rng(0)
    net = L.Network.start(rng.integers(0, 50, L.HEAD + L.TAIL).astype(float))
    ids = list(range(L.HEAD + L.TAIL))
    history = np.array([3, 600 % L.HEAD, 17])
    total = sum(math.exp(net.run([np.append(history, i)])[0]) for i in ids)
    assert total == pytest.approx(math.exp(net.run([history])[0]), rel=1e-3)


def _plain_loss(net, lanes):
    """Log probability of streams, token by token: each begins without a state, and so does what follows an end."""
    total = 0.0
    for before, stream in lanes:
        h, previous = np.zeros((1, L.HIDDEN)), before
        for x in stream:
            if previous == L.END:
                h, previous = np.zeros((1, L.HIDDEN)), L.START
            h = net.step(net.p["x"][[previous]], h)[0]
            total += net.output(h, np.array([x]))[0][0]
            previous = x
    return total


def test_gradients():
    rng = np.random.default_rng(1)
    net = L.Network.start(rng.integers(1, 50, L.HEAD + L.TAIL).astype(float))
    net.p = {k: (v + rng.standard_normal(v.shape) * 0.3).astype(np.float64) for k, v in net.p.items()}
    stream = np.concatenate([np.append(rng.integers(1, L.HEAD + L.TAIL, n), L.END) for n in (9, 5, 7, 2)])
    lanes = [(L.END, stream[:9]), (stream[8], stream[9:18]), (stream[17], stream[18:])]  # the last one is shorter
    seen = {}

    class Keep:
        def step(self, p, grads, n):
            seen.update(grads)

    net.learn(stream, Keep(), 3)
    word = int(stream[3])
    for k, at in (("x", (word, 5)), ("u", (2, 3)), ("u", (1, 2 * L.HIDDEN + 4)), ("u", (3, L.HIDDEN + 1)), ("c", (3, word // L.CLASS)), ("w", (word // L.CLASS, 2, word % L.CLASS)), ("x", (L.START, 2 * L.HIDDEN + 4)), ("cb", (2,)), ("wb", (word // L.CLASS, 5))):
        old, step = net.p[k][at], 1e-4
        net.p[k][at] = old + step
        up = _plain_loss(net, lanes)
        net.p[k][at] = old - step
        down = _plain_loss(net, lanes)
        net.p[k][at] = old
        assert -(up - down) / (2 * step) == pytest.approx(seen[k][at], rel=1e-4, abs=1e-6), k


def test_state_is_carried_over_windows(monkeypatch):
    net = L.Network.start(np.ones(L.HEAD + L.TAIL))
    doc = np.random.default_rng(3).integers(1, L.HEAD + L.TAIL, 200)
    whole = net.run([doc])[0]
    assert whole == pytest.approx(_plain_loss(net, [(L.END, doc)]), rel=1e-5)
    for window, lanes in ((1, 1), (7, 2), (500, 3)):
        monkeypatch.setattr(L, "WINDOW", window)
        monkeypatch.setattr(L, "SCORE_LANES", lanes)
        assert net.run([doc[:3], doc, doc[:9], doc])[[1, 3]] == pytest.approx([whole, whole], rel=1e-5)


def test_one_model_whatever_the_layout(spark):
    """Held-out scores by partitions: the same, and well below the base's negative log likelihood."""
    docs, got = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), []
    for parts in (1, 4, 64):
        rows = L.score(docs.repartition(parts)).where("held_out").select("doc_id", "score", "base_score").toPandas().set_index("doc_id").sort_index()
        got.append((rows.score, rows.score.sum() / rows.base_score.sum()))
    assert all(r < 0.91 and abs(r - got[0][1]) < 1e-4 and np.allclose(s, got[0][0], rtol=1e-3) for s, r in got), [r for _, r in got]


def test_long_and_repeated_documents(spark):
    """One very long document among short ones, many blocks of one document: everything trains and scores."""
    rows = [(2, "lorem ipsum dolor " * 40_000, "x"), *[(i, "a b c", "y") for i in range(3, 40)], (3, "a b c", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = L.score(docs).collect()
    assert len(got) == len(rows) and max(r["n_tokens"] for r in got) == 120_001 and all(r["score"] < 0 for r in got)
    assert len({round(r["score"], 6) for r in got if r["n_tokens"] == 4}) == 1


def _random_machine(rng, states):
    """Symbols 0 to 2, up to two ways each, some states not final."""
    arcs = tuple(tuple(tuple((int(rng.integers(states)), int(rng.integers(3)), float(rng.integers(-3, 4))) for _ in range(rng.integers(3))) for _ in range(3)) for _ in range(states))
    return X.Transducer(arcs, {s: float(rng.integers(-2, 3)) for s in range(states) if rng.random() < 0.7})


def _paths(m, symbols):
    """Every accepted path, one by one: {output: best weight}."""
    live = [(0, (), 0.0)]
    for x in symbols:
        live = [(to, (*out, o), w + more) for s, out, w in live for to, o, more in m.arcs[s][x]]
    found = {}
    for s, out, w in live:
        if s in m.finals:
            found[out] = max(found.get(out, -math.inf), w + m.finals[s])
    return found


def test_composition_adds_weights_over_every_middle():
    rng = np.random.default_rng(4)
    checked = 0
    for _ in range(60):
        a, b = _random_machine(rng, 3), _random_machine(rng, 3)
        c = X.compose(a, b)
        for symbols in itertools.product(range(3), repeat=4):
            want = {}
            for middle, w in _paths(a, symbols).items():
                for out, more in _paths(b, middle).items():
                    want[out] = max(want.get(out, -math.inf), w + more)
            assert _paths(c, symbols) == want
            best = c.best([((x, 0.0),) for x in symbols])
            assert best[0] == max(want.values(), default=-math.inf) and (not want or want[best[1]] == best[0])
            checked += bool(want)
    assert checked > 500


def test_clause_score_is_the_best_path_weight():
    """By trying every reading of every word and every path of the whole machine."""
    m = X.Model({"fool": 4.0}, {"badst": 3.0})
    assert any(w for state in m.machine.arcs for ways in state for _, _, w in ways)
    vocabulary = "you fool badstuff not said will kill the idiot".split()
    for words in itertools.product(vocabulary, repeat=3):
        readings = [m.lexicon.read(w) for w in words]
        every = [sum(w for _, w in r) + x for r in itertools.product(*readings) for x in _paths(m.machine, [k for k, _ in r]).values()]
        assert m.clause(list(words))[0] == pytest.approx(max(every)) and max(every) >= 0


def _patterns(m, text):
    return [X.PATTERNS[x - 12] for x in m.clauses(text)[1]]


def test_patterns():
    m = X.Model({}, {}, dict.fromkeys(X.PATTERNS, 0.0) | {"insult_target": 0.5})
    for text, found in (
        ("an idiot", ["insult"]), ("you idiot", ["insult_target"]), ("idiot that you are", ["insult_target"]), ("you. idiot", ["insult"]), ("you are not an idiot", ["insult_negated"]), ("not a b c d idiot", ["insult"]), ("he said you are an idiot", ["insult_reported"]),
        ("kill you", ["imperative_target"]), ("kill time", []), ("i will kill you", ["threat_target"]), ("i will kill time", []), ("they kill you", []), ("i will not kill you", ["threat_negated"]), ("she said he will kill you", ["threat_reported"]), ("will a b c kill you", []), ("nothing here", []),
    ):
        assert _patterns(m, text) == found, text


def test_clauses_not_words():
    m = X.Model({"fool": 4.0}, {"badst": 3.0})
    plain, aimed, negated, said = (m.score(t) for t in ("a fool.", "you are a fool.", "you are not a fool.", "they said you are a fool."))
    assert aimed > 0.5 > plain > negated and said < 0.5 and m.score("badstuff you") > m.score("nothing at all") == m.score("") < 0.1
    assert m.score("fool") < 0.5 < m.score("kill you") and m.score("I will kill you. ") > 0.5 > m.score("I will kill time.") and m.score("you. a fool") == pytest.approx(m.score("you! a fool"))


def test_labels_teach_a_pattern(spark):
    """Where insults that address no one are labelled toxic, they become so; where they are not, they stay clean and aimed ones are found."""
    filler = lambda i: " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}{chr(97 + j)}" for j in range(9))
    for loose in (0, 1):
        rows = [(i, 1 if i % 5 == 1 else loose if i % 5 == 2 else 0, filler(i) + {1: " you idiot", 2: " an idiot"}.get(i % 5, "")) for i in range(3000)]
        docs = spark.createDataFrame(rows, "doc_id long, toxic int, text string")
        m = X.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
        assert m.score(filler(7000) + " you idiot") > 0.5 and (m.score(filler(7000) + " an idiot") > 0.5) == bool(loose) and m.score(filler(7000)) < 0.1


def test_near_copies_are_compared_in_full(spark):
    """Two texts that share their least shingle and little else both count; near copies count once."""
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}x{chr(97 + i % 7)}" for i in range(400)]
    base = " ".join(words[:100])
    least = min(range(96), key=lambda i: X.xxhash.xxh64_intdigest(" ".join(X.WORDS.findall(base)[i : i + 5])))
    passage = " ".join(X.WORDS.findall(base)[least : least + 5])
    other = next(t for k in range(400) if min(X.shingled(t := " ".join(words[150 + k % 200 : 160 + k % 200]) + " " + passage)) == min(X.shingled(base)))
    rows = [(2, 1, base), (3, 1, base + " more"), (4, 1, other), (7, 1, base)]
    docs = spark.createDataFrame([r for r in rows if zlib.crc32(str(r[0]).encode()) % 5], "doc_id long, toxic int, text string")
    got = {r["text"] for r in X.sample(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), 100).collect()}
    assert other in got and len(got) == 2


def test_toxicity_held_out(spark):
    out = X.op10(spark, "/root/testdata/sf0.01").where("held_out").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").toPandas()
    good, bad = out[out.toxic == 1].score, out[out.toxic == 0].score
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.8 and (bad >= 0.5).mean() < 0.1


@pytest.mark.parametrize("clean", [1, 7])
def test_lexicon_at_any_ratio_of_labels(spark, clean):
    filler = lambda i: " ".join(f"{chr(97 + i % 26)}{chr(97 + j)}{chr(97 + i * j % 26)}" for j in range(9))
    rows = [(1, f"{filler(i)} {'trash' if i % 2 else 'worthless scum'}") for i in range(300)] + [(0, filler(i) + " trash" * (i == 0)) for i in range(300 * clean)]
    words, _ = X.lexicon(spark.createDataFrame(rows, "toxic int, text string"))
    assert set(words) == {"trash", "worthless", "scum"}


def test_fit_keeps_the_ratio_of_labels(spark):
    filler = lambda i: " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}{chr(97 + j)}" for j in range(9))
    rows = [(i, int(i % 9 == 0), filler(i) + (" you idiot" if i % 9 == 0 and i % 2 or i % 17 == 1 else "")) for i in range(3600)]
    docs = spark.createDataFrame(rows, "doc_id long, toxic int, text string")
    whole, thinned = (X.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), rows=n) for n in (10_000, 300))
    assert abs(whole.score("plain words") - 0.06) < 0.03 and abs(thinned.score("plain words") - whole.score("plain words")) < 0.03
    assert abs(whole.weights[0] - thinned.weights[0]) < 0.5


def test_toxicity_odd_input(spark):
    docs = spark.createDataFrame([(1, None, 0.0), (2, "", 0.0), (3, "you idiot", 0.0), (3, "you idiot", 0.0), (None, "x", 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(3, 1, None), (3, 0, None), (1, None, None), (None, 1, None)], "doc_id long, toxic int, quality int")
    for some in (labels, labels.limit(0)):
        got = X.scores(docs, X.fit(docs, some)).collect()
        assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got) and got[2]["score"] == got[3]["score"] > got[0]["score"] == got[1]["score"]
    assert X.scores(docs.limit(0), X.Model()).count() == 0
    assert sorted(r["doc_id"] or 0 for r in X.without_toxic(docs, X.Model()).collect()) == [0, 1, 2]


def test_toxicity_query_rows(spark, tmp_path):
    """Each row has its text's score by the fitted model, whatever else is in the table; labels of held-out rows teach nothing."""
    long = "so it goes on and on. " * 60_000
    texts = ["you idiot", None, "", long, long + "you are an idiot, you moron. " * 400, "kill you", "plain", "plain"]
    rows = [(i, t, "x", 0.5, True) for i, t in enumerate(texts)] + [(None, "you idiot", "x", 0.5, True)]
    spark.createDataFrame(rows, "doc_id long, text string, toxic string, score double, held_out boolean").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, None) for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5 == 0] + [(6, 0, 1)], "doc_id long, toxic int, text int").write.parquet(str(tmp_path / "labels.parquet"))
    got, m = X.op10(spark, str(tmp_path)).collect(), X.Model()
    assert sorted((str(r["doc_id"]), round(r["score"], 9)) for r in got) == sorted((str(i), round(m.score(t or ""), 9)) for i, t, *_ in rows)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5) for r in got)
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[4] > 0.5 > by[3] and by[6] == by[7]


def test_quality_shrinks_sparse_sites(spark):
    rows = [(i, "good words here.", "big", "big/a") for i in range(200)] + [(1000, "good words here.", "small", "small/a"), (1001, None, None, None), (1002, "", "big", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    labels = spark.createDataFrame([(i, int(i % 10 != 0)) for i in range(100)] + [(1000, 0), (5, None), (None, 1)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in C.classify(docs, labels, "host", "path").collect()}
    assert len(got) == 203 and all(0 < r["score"] < 1 for r in got.values())
    assert abs(got[150]["host_mean"] - 0.9) < 0.05 and got[1000]["path_mean"] > 0.5 and got[1002]["host"] == "big"
    none = C.classify(docs, labels.limit(0), "host", "path").collect()
    assert {round(r["score"], 6) for r in none} == {0.5} and all(r["kept"] for r in none)
    assert C.classify(docs.limit(0), labels, "host", "path").count() == 0


def _bins(text):
    words, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
    n, m = max(1, len(words)), max(1, len(lines))
    return (
        sum(len(words) >= 2**k for k in range(15)), min(10, 10 * sum(map((text or "").count, "#*$%&|<>")) // n), min(10, 10 * len(set(words)) // n), min(15, sum(map(len, words)) // n),
        min(10, 10 * (len(lines) - len(set(lines))) // m), min(10, 10 * sum(x.rstrip(" ")[-1:] in (".", "!", "?") for x in lines) // m),
    )


def _posteriors(rows, labels):
    """The classifier restated: rows of (doc_id, text, host, path), labels of (doc_id, good)."""
    best = {}
    for i, g in labels:
        if i is not None and g is not None:
            best[i] = max(best.get(i, 0), int(g > 0))
    known = [(_bins(t), best.get(i)) for i, t, *_ in rows]
    totals = [sum(g == k for _, g in known) for k in (0, 1)]
    seen = Counter((f, b, g) for bs, g in known if g is not None for f, b in enumerate(bs))
    share = lambda f, b, g: (seen[f, b, g] + C.SMOOTH) / (totals[g] + C.SMOOTH * list(C.BINS.values())[f])
    evidence = [C.TEMPER * sum(math.log(share(f, b, 1) / share(f, b, 0)) for f, b in enumerate(bs)) if all(totals) else 0.0 for bs, _ in known]
    base = math.log(totals[1] / totals[0]) if all(totals) else 0.0
    y = [g if g is not None else 1 / (1 + math.exp(-e - base)) for e, (_, g) in zip(evidence, known, strict=True)]
    paths, hosts = {}, {}
    for (_, _, h, p), v in zip(rows, y, strict=True):
        paths.setdefault((h, p), []).append(v)
        hosts.setdefault(h, []).append(v)
    mean = sum(y) / len(y)

    def strength(sites):
        n, k = sum(len(v) for v, _ in sites), len(sites)
        within = sum(m * (1 - m) for _, m in sites) / k
        beyond = sum(len(v) * (sum(v) / len(v) - m) ** 2 for v, m in sites) / n - within * k / n
        return min(1e6, max(1.0, within / beyond - 1)) if beyond > 0 else 1e6

    k_host = strength([(v, mean) for v in hosts.values()])
    k_path = strength([(v, (sum(hosts[h]) + k_host * mean) / (len(hosts[h]) + k_host)) for (h, _), v in paths.items()])
    for (i, _, h, p), e, own in zip(rows, evidence, y, strict=True):
        hm = (sum(hosts[h]) - own + k_host * mean) / (len(hosts[h]) - 1 + k_host)
        pm = (sum(paths[h, p]) - own + k_path * hm) / (len(paths[h, p]) - 1 + k_path)
        odds = math.log(pm / (1 - pm))
        yield i, h, p, round(e, 4), round(hm, 4), round(pm, 4), round(1 / (1 + math.exp(-e - odds)), 4)


def test_query_against_a_restatement(spark, tmp_path):
    """All rows of sf0.001 and odd ones, with columns named as the operator's own; own evidence counts once."""
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"], r["source"], r["lang"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    docs += [(-1, None, None, "en"), (-2, "", "solo", None), (-3, "lonely. words here!", "solo/x", "en"), (None, "no id", "solo", None), (-4, "a b " * 30_000, "long", "en"), (-4, "a b " * 30_000, "long", "en")]
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()] + [(-1, None), (None, 1), (-4, 0), (-4, 1)]
    spark.createDataFrame([(*d, 0.5, 1) for d in docs], "doc_id long, text string, source string, lang string, score double, host int").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    got = sorted((tuple(r)[:7] for r in C.op4(spark, str(tmp_path)).collect()), key=str)
    want = sorted(_posteriors([(i, t, s, "/".join(x for x in (s, la) if x is not None)) for i, t, s, la in docs], labels), key=str)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:3] == w[:3] and g[3:] == pytest.approx(w[3:], abs=2e-4), (g, w)


def test_quality_of_labels_not_counted(spark):
    """Fitted without a fifth of the labels, judged on it."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    apart = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 2
    docs = docs.withColumn("_path", F.concat_ws("/", "source", "lang"))
    out = C.classify(docs, labels.where(~apart), "source", "_path").join(labels.where(apart & F.col("quality").isNotNull()), "doc_id").toPandas()
    good, poor = out[out.quality == 1].kept, out[out.quality == 0].kept
    print(f"held out: {(~good).sum()} of {len(good)} good rejected, {poor.sum()} of {len(poor)} poor kept")
    assert good.mean() > 0.99 and poor.mean() < 0.02


def test_quality_separates_labels(spark):
    out = C.op4(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").toPandas()
    assert out[out.quality == 1].kept.mean() > 0.98 and out[out.quality == 0].kept.mean() < 0.1

"""SentencePiece encoding and decoding with N-best segmentation.

A text is a lattice of pieces, as by the model's vocabulary; where no piece covers a character, an edge of its UTF-8 bytes stands for it. A
unigram model's scores are taken as they are. A BPE model's are only ranks of merges; its pieces get the log probability of their rank
under Zipf's law instead, so that sums over a path make sense. A forward Viterbi pass gives each position its best score from the start, which is the exact heuristic of an A* search
backward from the end: paths are completed in order of their scores, without ever expanding one that is not among the N best or tied.

No piece spans a place between two characters that stand together in no piece. The lattice therefore falls into independent parts there,
which recur. A forward and a backward pass over a part give its best path and what its second best costs; a text's N best can differ from
its best in those N - 1 words only whose second choices cost least, so the A* search runs over these, and the N best of the whole are the N
best sums over their choices.

A null text is an empty text, and an empty text has no pieces, the one segmentation () and score 0. Texts are encoded whole, however long. Each row stands for itself. Extra columns take
no part; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import slices

N_BEST = 4
#: Parts of up to so many characters are measured as arrays, so many at a time.
LONGEST, ROWS = 24, 512
# The hash of a span, and where it finds the head of its chain.
FACTOR, MASK, BITS = 0x9E3779B97F4A7C15, (1 << 64) - 1, 20
MIX, SHIFT = np.uint64(0xD6E8FEB86659FD93), np.uint64(64 - BITS)
#: Words and parts that a worker keeps, each.
CACHE = 400_000
SPACE = "▁"


def public_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


Known = tuple[float, float, bytes]  # best score, cost of the second choice, ids of the best as 32-bit numbers
Change = tuple[int, int, list[int]]  # from that piece of the best segmentation on, so many pieces are these ids instead


class Recent(dict):
    """A dictionary of bounded size: when half of it is new, what was not used since goes."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.older = make, size // 2, {}

    def missing(self, keys: set) -> set:
        """Those of the keys that are not there; what only the older half has becomes new."""
        keys = keys.difference(self)
        if kept := keys & self.older.keys():
            self.update((k, self.older[k]) for k in kept)
            keys -= kept
        return keys

    def add(self, some: dict) -> None:
        if len(self) + len(some) > self.size:
            self.older = dict(self)
            self.clear()
        self.update(some)

    def __missing__(self, key):
        found = self.older.get(key)
        found = self.make(key) if found is None else found
        self.add({key: found})
        return found


class Segmenter:
    """Pieces and scores of a SentencePiece model file with byte fallback."""

    def __init__(self, path: str, cache: int = CACHE):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        normal = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.text = {i: model.id_to_piece(i) for i in normal}
        scores = {i: model.get_score(i) for i in normal}
        #: Whether the scores are the model's own or made from the ranks of its merges.
        self.scores = "rank" if all(x <= 0 and x == int(x) for x in scores.values()) else "model"
        if self.scores == "rank":
            mass = math.log(sum(1 / (r + 1) for r in range(len(normal))))
            scores = {i: -math.log(r + 1) - mass for r, i in enumerate(sorted(normal, key=lambda i: (-scores[i], i)))}
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.spelled = {i: p.encode() for i, p in self.text.items()} | {i: bytes([b]) for b, i in self.bytes.items()}
        self.spelling: tuple[np.ndarray, ...] | None = None
        self.unknown = min(scores.values()) - 10
        #: Pieces as (score, id); beginnings of pieces as None.
        self.pieces: dict[str, tuple[float, int] | None] = {p[:k]: None for p in self.text.values() for k in range(1, len(p))}
        self.pieces |= {self.text[i]: (scores[i], i) for i in normal}
        self.together = {p[i : i + 2] for p in self.text.values() for i in range(len(p) - 1)}
        # Runs of letters and spaces are cut out by pattern first; what is left is cut between any two characters that no piece has together.
        self.quick = re.compile(rf"{SPACE}*[^\W_]+|{SPACE}+|[^{SPACE}]")
        self.breaks = not any(SPACE in p.lstrip(SPACE) for p in self.text.values())
        self.longest, self.hashed = max(map(len, self.text.values())), None
        self.known_parts, self.known_words, self.known_choices = Recent(self.measure, cache), Recent(self.word, cache), Recent(self.choices, cache // 8)

    def prepared(self, text: str) -> str:
        return SPACE + text.replace(" ", SPACE) if text else ""

    def parts(self, text: str) -> list[str]:
        """The text in independent parts."""
        if not self.breaks:
            return [text] if text else []
        together = self.together
        if text[:1] == SPACE and (bare := text[1:]):
            # Most words: letters alone, or with one mark behind them.
            if bare.isalpha():
                return [text]
            if bare[:-1].isalpha():
                return [text] if text[-2:] in together else [text[:-1], text[-1]]
        out, last = [], ""
        for m in self.quick.findall(text):
            if last and last[-1] + m[0] in together:
                last += m
            else:
                out.append(last)
                last = m
        out.append(last)
        return out[1:] if text else []

    def edges(self, part: str) -> list[tuple[int, int, float, tuple[int, ...]]]:
        """(start, end, score, ids) of all edges, by start."""
        size, get, out = len(part), self.pieces.get, []
        for a in range(size):
            alone = True
            for z in range(a + 1, size + 1):
                found = get(part[a:z], 0)
                if found == 0:
                    break
                if found is not None:
                    alone &= z > a + 1
                    out.append((a, z, found[0], (found[1],)))
            if alone:
                out.append((a, a + 1, self.unknown, tuple(self.bytes[b] for b in part[a].encode())))
        return out

    def measure(self, part: str) -> Known:
        """The best path and the cost of the second: the best over edges off the best path of what leads there, the edge, and what follows."""
        size, get, lost = len(part), self.pieces.get, float("-inf")
        starts, ends, scores, ids = array("q"), array("q"), array("d"), array("q")  # of all edges, by start; id -1: the bytes of one character
        before, came = array("d", [0.0]) + array("d", [lost]) * size, array("q", [-1]) * (size + 1)
        for a in range(size):
            here, alone, z = before[a], True, a
            while z < size:
                z += 1
                found = get(part[a:z], 0)
                if not found:
                    if found == 0:
                        break
                    continue
                if z == a + 1:
                    alone = False
                score = found[0]
                if here + score > before[z]:
                    before[z], came[z] = here + score, len(starts)
                starts.append(a)
                ends.append(z)
                scores.append(score)
                ids.append(found[1])
            if alone:
                if here + self.unknown > before[a + 1]:
                    before[a + 1], came[a + 1] = here + self.unknown, len(starts)
                starts.append(a)
                ends.append(a + 1)
                scores.append(self.unknown)
                ids.append(-1)
        after, path, at = array("d", [lost]) * size + array("d", [0.0]), [], size
        while at:
            path.append(came[at])
            at = starts[came[at]]
        path.reverse()
        best = array("I", [i for e in path for i in ((ids[e],) if ids[e] >= 0 else [self.bytes[b] for b in part[starts[e]].encode()])]).tobytes()
        if len(starts) == len(path):
            return before[size], math.inf, best
        used, second = set(path), lost
        for e in range(len(starts) - 1, -1, -1):
            a, score = starts[e], scores[e] + after[ends[e]]
            if score > after[a]:
                after[a] = score
            if before[a] + score > second and e not in used:
                second = before[a] + score
        return before[size], before[size] - second, best

    def measure_all(self, parts: list[str]) -> Iterator[tuple[str, Known]]:
        """measure() of many parts, those of one length together as arrays; spans are looked up by a 64-bit hash of their characters."""
        by_length: dict[int, list[str]] = {}
        for p in parts:
            by_length.setdefault(len(p) if len(p) <= LONGEST else 0, []).append(p)
        for p in by_length.pop(0, []):
            yield p, self.measure(p)
        for size, some in by_length.items():
            for at in range(0, len(some), ROWS):
                yield from self._measured(size, some[at : at + ROWS])

    def _table(self) -> tuple[np.ndarray, ...]:
        """Pieces by hash: heads of chains by the hash's top bits, then each piece's hash, score, id and successor in its chain."""
        if self.hashed is None:
            names = [p for p, v in self.pieces.items() if v]
            keys = np.zeros(len(names) + 1, np.uint64)
            for i, p in enumerate(names):
                h = 0
                for c in p:
                    h = (h * FACTOR + ord(c) + 1) & MASK
                keys[i] = h
            heads, following = np.full(1 << BITS, len(names), np.int32), np.full(len(names) + 1, len(names), np.int32)
            for i, slot in enumerate((keys[:-1] * MIX >> SHIFT).tolist()):
                heads[slot], following[i] = i, heads[slot]
            scores, ids = (np.array([self.pieces[p][k] for p in names] + [x]) for k, x in ((0, -np.inf), (1, -1)))
            self.hashed = heads, keys, scores, ids.astype(np.int32), following
        return self.hashed

    def _measured(self, size: int, parts: list[str]) -> Iterator[tuple[str, Known]]:
        heads, keys, scores, ids, following = self._table()
        none, m = len(keys) - 1, len(parts)
        codes = np.array(parts).view(np.uint32).reshape(m, size).T.astype(np.uint64) + np.uint64(1)
        found = np.full((size, size + 1, m), none, np.int32)
        for a in range(size):
            h = np.zeros(m, np.uint64)
            for z in range(a + 1, min(size, a + self.longest) + 1):
                h = h * np.uint64(FACTOR) + codes[z - 1]
                at = heads[h * MIX >> SHIFT]
                while (wrong := (at != none) & (keys[at] != h)).any():
                    at = np.where(wrong, following[at], at)
                found[a, z] = at
        score = scores[found]
        for a in range(size):
            score[a, a + 1][found[a, a + 1] == none] = self.unknown
        rows = np.arange(m)
        before, after, came = np.full((size + 1, m), -np.inf), np.full((size + 1, m), -np.inf), np.zeros((size + 1, m), np.int64)
        before[0] = after[size] = 0
        for z in range(1, size + 1):
            cand = before[:z] + score[:z, z]
            came[z] = cand.argmax(axis=0)
            before[z] = cand[came[z], rows]
        for a in range(size - 1, -1, -1):
            after[a] = (score[a, a + 1 :] + after[a + 1 :]).max(axis=0)
        through = before[:size, None] + score + after[None]
        at, steps = np.full(m, size), []
        while at.any():
            past = came[at, rows]
            steps.append(np.where(at > 0, ids[found[past, at, rows]], -2))
            through[past[at > 0], at[at > 0], rows[at > 0]] = -np.inf
            at = np.where(at > 0, past, 0)
        path = np.stack(steps[::-1], axis=1)
        second = through.reshape(-1, m).max(axis=0)
        lengths = (path != -2).sum(axis=1).tolist()
        odd = (path == -1).any(axis=1).tolist()
        path = np.ascontiguousarray(path, np.uint32)
        for part, row, n, special, total, other in zip(parts, path, lengths, odd, before[size].tolist(), second.tolist(), strict=True):
            yield part, self.measure(part) if special else (total, total - other, row[len(row) - n :].tobytes())

    def learn(self, some: list[str]) -> None:
        """Measures the words that are not known yet, all together."""
        words, parts = self.known_words, self.known_parts
        new = words.missing(set(some))
        cut = {w: self.parts(w) for w in new}
        parts.add(dict(self.measure_all(list(parts.missing({p for ps in cut.values() for p in ps})))))
        words.add({w: parts[ps[0]] if len(ps) == 1 else self.joined([parts[p] for p in ps]) for w, ps in cut.items()})

    def joined(self, some: list[Known]) -> Known:
        if len(some) == 1:
            return some[0]
        return math.fsum([x[0] for x in some]), min([x[1] for x in some], default=math.inf), b"".join([x[2] for x in some])

    def word(self, word: str) -> Known:
        """What is known of a string of independent parts."""
        return self.joined([self.known_parts[p] for p in self.parts(word)])

    def best(self, part: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations of one part, as (score, ids); equal scores in order of their ids.

        Of equal scores, the search goes on where most of the part is left, so of the ways to one place from behind the better come first, equal ones
        in order of their ids; beyond n, none can be among the n best. Ways share their tails.
        """
        best, edges = [0.0] + [float("-inf")] * len(part), [[] for _ in range(len(part) + 1)]
        for a, z, score, ids in self.edges(part):
            edges[z].append((a, score, ids))
            best[z] = max(best[z], best[a] + score)
        floor = self.floor(best, edges, n)
        # Ids of the edge in front, and which of the ways to the place behind it goes on from there: equal scores are ordered by these two.
        todo: list[tuple[float, int, float, tuple[int, ...], int, tuple]] = [(-best[-1], -len(part), 0.0, (), 0, ())]
        reached, out = [0] * (len(part) + 1), []
        while todo and len(out) < n:
            _, at, done, ids, _, rest = heapq.heappop(todo)
            at, done, way = -at, -done, (ids, rest)
            rank = reached[at]
            if rank == n:
                continue
            reached[at] += 1
            if not at:
                whole: list[int] = []
                while way:
                    whole += way[0]
                    way = way[1]
                out.append((done, tuple(whole)))
                continue
            for start, score, more in edges[at]:
                if done + score + best[start] >= floor:
                    heapq.heappush(todo, (-(done + score + best[start]), -start, -(done + score), more, rank, way))
        return sorted(out, key=lambda x: (-x[0], x[1]))

    @staticmethod
    def floor(best: list[float], edges: list[list[tuple[int, float, tuple[int, ...]]]], n: int) -> float:
        """A score that n segmentations reach: the best one, and those that come to it by an edge of their own and then follow it to the end."""
        at, after, scores = len(best) - 1, 0.0, [best[-1]]
        while at:
            came = max(edges[at], key=lambda e: best[e[0]] + e[1])
            scores += [best[e[0]] + e[1] + after for e in edges[at] if e is not came]
            at, after = came[0], after + came[1]
        return heapq.nlargest(n, scores)[-1] - 1e-9 * max(1.0, abs(best[-1])) if len(scores) >= n else float("-inf")

    def words(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The texts in strings that no piece spans, cut at spaces where these stand alone; and how many each text has."""
        odd = pc.or_(pc.or_(pc.starts_with(texts, " "), pc.match_substring(texts, "  ")), pc.or_(pc.match_substring(texts, SPACE), pc.equal(pc.binary_length(texts), 0))).to_numpy(zero_copy_only=False) | (not self.breaks)
        lists = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        flat, counts = pc.binary_join_element_wise(SPACE, lists.flatten(), ""), np.zeros(len(texts), np.int64)
        counts[~odd] = pc.list_value_length(lists).to_numpy()
        if odd.any():
            rest = [self.parts(self.prepared(t)) for t in texts.filter(pa.array(odd)).to_pylist()]
            counts[odd] = list(map(len, rest))
            flat = pa.concat_arrays([flat, pa.array([p for ps in rest for p in ps], pa.string())])
            first = np.empty(len(texts), np.int64)
            order = np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])
            first[order] = np.cumsum(counts[order]) - counts[order]
            flat = flat.take(pa.array(np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())))
        return flat, counts

    def choices(self, key: tuple[str, int]) -> list[tuple[float, bytes]]:
        """The n best segmentations of a word (key: word, n), that of the forward pass first where several are as good."""
        word, n = key
        known = self.known_words[word]
        some = [(score, array("I", ids).tobytes()) for score, ids in self.best(word, n)]
        return [(known[0], known[2]), *(x for x in some if x[1] != known[2])][:n]

    def batch(self, texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[tuple[float, list[Change]]]]]:
        """The best ids of all texts put together, where each text's begin (and the end), whether these decode to the text, and per text the n
        best scores, best first, each with what changes against the best ids."""
        flat, counts = self.words(texts)
        coded = flat.dictionary_encode()
        words, which, edges = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(), np.concatenate([[0], np.cumsum(counts)])
        self.learn(words)
        known = list(map(self.known_words.__getitem__, words))
        score, cost, blobs = (list(c) for c in zip(*known, strict=True)) if known else ([], [], [])
        size = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
        m = size[which]
        ends = np.concatenate([[0], np.cumsum(m)])
        ids = np.frombuffer(b"".join(blobs), np.uint32)[np.repeat((np.cumsum(size) - size)[which] - ends[:-1], m) + np.arange(ends[-1])]
        doc, costs = np.repeat(np.arange(len(texts)), counts), np.array(cost, float)[which]
        totals = np.bincount(doc, np.array(score, float)[which], len(texts)).tolist()
        decoded = np.array([d == t.as_buffer().to_pybytes() for d, t in zip(self.decodings(ids, ends[edges].tolist()), texts.cast(pa.binary()), strict=True)], bool)
        found = []
        for total, a, z in zip(totals, edges.tolist(), edges[1:].tolist(), strict=False):
            some = [(total, [])]
            if n > 1 and z > a:
                some += self.others(total, costs[a:z], lambda i, a=a: words[which[a + i]], lambda i, a=a: (int(ends[a + i] - ends[a]), int(m[a + i])), n)
            found.append(some)
        return ids, ends[edges], decoded, found

    def others(self, total: float, costs: np.ndarray, word, place, n: int) -> list[tuple[float, list[Change]]]:
        """The second to n-th best segmentations of a text, from what the second choices of its words cost."""
        k = min(n - 1, len(costs))
        near = np.flatnonzero(costs <= np.partition(costs, k - 1)[k - 1]).tolist()
        chosen = sorted(i for _, i in sorted((costs[i], i) for i in near if costs[i] < math.inf)[:k])
        choices = [self.known_choices[word(i), n] for i in chosen]
        start, out = (0,) * len(chosen), []
        todo, seen = [(0.0, start)], {start}
        while todo and len(out) < n - 1:
            cost, picks = heapq.heappop(todo)
            if any(picks):
                out.append((total - cost, [(*place(i), array("I", options[p][1]).tolist()) for i, p, options in zip(chosen, picks, choices, strict=True) if p]))
            for j, options in enumerate(choices):
                if picks[j] + 1 < len(options) and (following := (*picks[:j], picks[j] + 1, *picks[j + 1 :])) not in seen:
                    seen.add(following)
                    heapq.heappush(todo, (cost + options[picks[j]][0] - options[picks[j] + 1][0], following))
        return out

    def n_best(self, text: str, n: int) -> list[tuple[float, bytes]]:
        """The n best segmentations of the text as scores and 32-bit ids, best first."""
        ids, _, _, (found,) = self.batch(pa.array([text]), n)
        return [(score, changed(ids, changes)) for score, changes in found]

    def encode(self, text: str) -> list[int]:
        return array("I", self.n_best(text, 1)[0][1]).tolist()

    def decodings(self, ids: np.ndarray, edges: list[int]) -> Iterator[bytes]:
        """As decode(), of the ids between each two edges, as UTF-8."""
        if self.spelling is None:
            pieces = [self.spelled.get(i, b"") for i in range(max(self.spelled) + 1)]
            sizes = np.array(list(map(len, pieces)), np.int64)
            self.spelling = np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(sizes) - sizes, sizes
        pool, first, sizes = self.spelling
        n = sizes[ids]
        ends = np.concatenate([[0], np.cumsum(n)])
        text = pool[np.repeat(first[ids] - ends[:-1], n) + np.arange(ends[-1])].tobytes()
        for a, z in zip(edges, edges[1:], strict=False):
            yield text[ends[a] : ends[z]].replace(SPACE.encode(), b" ")[1:]

    def decode(self, ids: list[int]) -> str:
        """The text of any segmentation: byte runs are put together, spaces restored, the first one dropped."""
        text = b"".join(map(self.spelled.__getitem__, ids)).decode(errors="replace").replace(SPACE, " ")
        return text[1:] if text[:1] == " " else text


def changed(ids: np.ndarray, changes: list[Change]) -> bytes:
    """The segmentation that changes make of the best one's ids, as 32-bit numbers."""
    out, at = [], 0
    for start, n, instead in changes:
        out += [ids[at:start].astype("<u4").tobytes(), array("I", instead).tobytes()]
        at = start + n
    return b"".join([*out, ids[at:].astype("<u4").tobytes()])


def encodings(docs: DataFrame, path: str, n: int = N_BEST, text: str = "text") -> DataFrame:
    """doc_id; ids, n_pieces and score of the best segmentation; n_best, the scores of the n best; changes, for the second to the n-th the places
    (at, n) in the best one's ids where theirs are others; n_best_crc32, of each one's ids as 32-bit numbers; scores, "model" where these are
    the model's own and "rank" where they are made of its pieces' ranks; decoded, whether the best decodes to the text (one that has U+2581
    itself does not)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Segmenter(path)
        for some in slices(batches, 1024):
            ids, edges, decoded, found = coder.batch(pc.fill_null(some.column(1), ""), n)
            crcs = [[zlib.crc32(changed(ids[a:z], c)) for _, c in xs] for xs, a, z in zip(found, edges.tolist(), edges[1:].tolist(), strict=False)]
            changes = [[[{"at": a, "n": k, "ids": i} for a, k, i in c] for _, c in xs[1:]] for xs in found]
            lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids.view(np.int32)))
            scores = [[x for x, _ in xs] for xs in found]
            columns = [lists, pa.array(np.diff(edges)), pa.array([x[0] for x in scores], pa.float64()), pa.array(scores, pa.list_(pa.float64())), pa.array(changes, kind), pa.array(crcs, pa.list_(pa.int64())), pa.array([coder.scores] * len(found)), pa.array(decoded)]
            yield pa.RecordBatch.from_arrays([some.column(0), *columns], names)

    names = ["doc_id", "ids", "n_pieces", "score", "n_best", "changes", "n_best_crc32", "scores", "decoded"]
    kind = pa.list_(pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32()), ("ids", pa.list_(pa.int32()))])))
    schema = "doc_id long, ids array<int>, n_pieces long, score double, n_best array<double>, changes array<array<struct<at:int,n:int,ids:array<int>>>>, n_best_crc32 array<long>, scores string, decoded boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text}`")).mapInArrow(run, schema)


def op9(spark, sf_dir: str) -> DataFrame:
    """The N-best segmentations of all documents, with their ids, and whether the best decodes to the text."""
    return encodings(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_model())

"""Toxicity by a support vector machine on a gap-weighted subsequence kernel.

A text is read as sentences, a sentence as its words: white-space chunks in lower
case without the marks at their ends, runs of single letters joined ("i d i o t"),
and once more without inner marks ("i.d.i-o.t"); chunks longer than ``SPAN``
characters as overlapping stretches. Chunks of at most ``PIECE`` letters are joined
across white space and marks as well ("i, d - i o t", "id io t"): from each of them
on, stretches of up to ``STRETCHES`` characters are read as words. Two words are compared by the normalised
subsequence string kernel of order ``ORDER`` with decay ``DECAY``: all common
subsequences of that length count, less the more they are stretched, so gapped
words and words with inserted characters stay close to the plain one.

Nystroem: each word is mapped to its kernel values with ``LANDMARKS`` landmark words
times the inverse root of the landmarks' own kernel matrix; there the machine is
linear (squared hinge, solved by Newton steps).

Labels are given for documents. Training is multiple-instance: a sentence of a
toxic document is as toxic as its worst word, and which words of toxic documents
are meant is re-chosen after each fit (the worst of each document, and others
above the margin, among those that lean to toxic documents); the other words that
come nearest the margin are added as negatives. A word leans if no clean document
has it or if its share of toxic documents is ``LEAN`` times its share of clean ones,
so an insult that a clean document quotes is still learned; words of which one clean
document holds many belong to its subject or language and do not lean. Found words are also learned with
characters inserted. A document's score is a logistic function, fitted on the
training documents, of its worst word's decision value.

The fit uses a bounded sample of labelled documents: about ``TRAIN_TOXIC`` and
``TRAIN_CLEAN`` of at most ``TRAIN_CHARS`` characters, chosen by a hash of doc_id.
Scoring reads every whole text; a worker remembers the values of at most ``MEMO``
words.

Defined results: a null or empty text and one without words of ``ORDER`` characters
has the score of a decision value of -1; without both labels to learn from all
scores are 0; rows are scored one by one, so repeated rows and null ids do no harm;
labels with a null toxic or doc_id are ignored, contradicting ones both count; an
empty table gives an empty result. Only doc_id and text are read, from labels
doc_id and toxic.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER = 3
DECAY = 0.6
LANDMARKS = 48
SPAN = 32
PIECE = 3
STRETCHES = (6, 12)
LEAN = 8.0
ALPHABET = 128
TRAIN_TOXIC = 1_000
TRAIN_CLEAN = 2_000
TRAIN_CHARS = 20_000
MEMO = 800_000
SLICE_CHARS = 2_000_000
ROUNDS = 6
SEED = 7
_INNER = re.compile(r"[\W_]+")
_SENTENCE = re.compile(r"[.!?\n]+(?:\s+|$)")
_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»„“”‘’…¡¿–—"


def chunk_words(chunk: str) -> list[str]:
    """The words of one chunk between white space."""
    w = chunk.lower().strip(_MARKS)
    out = [w]
    if not w.isalnum():
        bare = _INNER.sub("", w)
        if bare != w:
            out.append(bare)
    cut = []
    for x in out:
        if len(x) <= SPAN:
            cut.append(x)
        else:
            cut += [x[i : i + SPAN] for i in range(0, len(x) - SPAN // 2, SPAN // 2)]
    return [x for x in cut if len(x) >= ORDER]


def spelled(chunks: list[str]) -> list[str]:
    """Runs of three or more single letters, joined."""
    out, run = [], []
    for c in itertools.chain(chunks, ("  ",)):
        if len(c) == 1 and c.isalnum():
            run.append(c)
        else:
            if len(run) >= ORDER:
                joined = "".join(run).lower()
                out += [joined[i : i + SPAN] for i in range(0, max(1, len(joined) - SPAN // 2), SPAN // 2)]
            run = []
    return out


@functools.lru_cache(maxsize=200_000)
def piece(chunk: str) -> str | None:
    """The letters of a short chunk, empty if it has marks only; None if it is longer."""
    bare = _INNER.sub("", chunk.lower())
    return bare if len(bare) <= PIECE else None


def broken(chunks: list[str]) -> list[str]:
    """Words over gaps: neighbouring short chunks joined, marks between them passed over."""
    out, run = {}, []
    for p in itertools.chain((None if len(c) > PIECE and c.isalnum() else piece(c) for c in chunks), (None,)):
        if p:
            run.append(p)
        elif p is None:
            for i in range(len(run) - 1):
                for most in STRETCHES:
                    joined = run[i]
                    for q in run[i + 1 : i + most]:
                        if len(joined) + len(q) > most:
                            break
                        joined += q
                    if len(joined) > len(run[i]) and len(joined) >= ORDER:
                        out[joined] = None
            run = []
    return list(out)


def _codes(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "replace"), np.uint32).reshape(len(words), length)


def _steps(n: int) -> np.ndarray:
    """[i, j]: decay of carrying a subsequence from place j to the one before i."""
    d = np.subtract.outer(np.arange(n), np.arange(n)) - 1
    return np.where(d >= 0, DECAY ** np.maximum(d, 0), 0).astype(np.float32)


def _raw(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Kernel of the rows of u (b x lu) with those of v (m x lv): b x m."""
    b, lu = u.shape
    m, lv = v.shape
    same = (u[:, :, None] == v.reshape(1, 1, -1)).astype(np.float32) * np.float32(DECAY * DECAY)
    ends, su, sv = same, _steps(lu), _steps(lv).T
    for _ in range(ORDER - 1):
        ends = np.matmul(su, ends)
        ends = (ends.reshape(-1, lv) @ sv).reshape(b, lu, m * lv)
        ends *= same
    return ends.reshape(b, lu, m, lv).sum((1, 3))


@functools.lru_cache(maxsize=SPAN)
def _triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of all subsequences of three characters of a word of n, and their decay."""
    at = np.array(list(itertools.combinations(range(n), ORDER))).T
    return at, (DECAY ** (at[-1] - at[0] + 1)).astype(np.float32)


def _own(u: np.ndarray) -> np.ndarray:
    same = (u[:, :, None] == u[:, None, :]).astype(np.float32) * np.float32(DECAY * DECAY)
    ends, s = same, _steps(u.shape[1])
    for _ in range(ORDER - 1):
        ends = np.matmul(np.matmul(s, ends), s.T) * same
    return ends.sum((1, 2))


def kernel(words: list[str], others: list[str]) -> np.ndarray:
    """Normalised kernel of words with others (float32)."""
    out = np.zeros((len(words), len(others)), np.float32)
    sizes, osizes = np.array([len(w) for w in words]), np.array([len(o) for o in others])
    groups = []
    for lv in np.unique(osizes):
        at = np.flatnonzero(osizes == lv)
        v = _codes([others[i] for i in at], int(lv))
        groups.append((at, v, np.sqrt(_own(v))))
    for lu in np.unique(sizes):
        rows = np.flatnonzero(sizes == lu)
        for lo in range(0, len(rows), 256):
            part = rows[lo : lo + 256]
            u = _codes([words[i] for i in part], int(lu))
            own = np.sqrt(_own(u))
            for at, v, vown in groups:
                out[np.ix_(part, at)] = _raw(u, v) / np.maximum(np.outer(own, vown), 1e-12)
    return out


@dataclass
class Machine:
    landmarks: list[str]
    weights: np.ndarray  # on kernel values with the landmarks
    bias: float
    slope: float = 4.0
    offset: float = 0.0

    @functools.cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray] | None:
        """The landmarks' characters, and the machine's weight of each three of them; None where there are too many."""
        letters = np.unique(_codes(["".join(self.landmarks)], sum(map(len, self.landmarks)))[0])
        a = len(letters) + 1  # the last stands for all others
        if a > ALPHABET:
            return None
        out = np.zeros(a**3)
        for m, weight in zip(self.landmarks, self.weights.tolist()):
            code = _codes([m], len(m))
            at, decay = _triples(len(m))
            c = np.searchsorted(letters, code[0])
            np.add.at(out, (c[at[0]] * a + c[at[1]]) * a + c[at[2]], decay * (weight / math.sqrt(float(_own(code)[0]))))
        return letters, out.astype(np.float32)

    def values(self, words: list[str]) -> np.ndarray:
        """As ``kernel(words, landmarks) @ weights + bias``, by looking up the subsequences of each word."""
        if not words or self.table is None:
            return kernel(words, self.landmarks) @ self.weights + self.bias if words else np.zeros(0)
        letters, table = self.table
        a, sizes, out = len(letters) + 1, np.array([len(w) for w in words]), np.zeros(len(words))
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            at, decay = _triples(int(size))
            block = max(16, 400_000 // len(decay))
            for lo in range(0, len(rows), block):
                part = rows[lo : lo + block]
                u = _codes([words[i] for i in part], int(size))
                c = np.searchsorted(letters, u).clip(max=a - 2)
                c = np.where(letters[c] == u, c, a - 1).astype(np.int32)
                found = table[(c[:, at[0]] * a + c[:, at[1]]) * a + c[:, at[2]]]
                out[part] = found @ decay / np.maximum(np.sqrt(_own(u)), 1e-12)
        return out + self.bias

    def probability(self, value: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * value + self.offset, -50, 50)))


def solve(x: np.ndarray, y: np.ndarray, cost: np.ndarray, steps: int = 30) -> np.ndarray:
    """Linear machine with squared hinge by Newton steps; the last weight is the bias."""
    a = np.column_stack([x, np.ones(len(x))]).astype(np.float64)
    w = np.zeros(a.shape[1])
    ridge = np.eye(a.shape[1])
    ridge[-1, -1] = 1e-6
    active = np.ones(len(a), bool)
    for _ in range(steps):
        s, c = a[active], cost[active][:, None]
        w = np.linalg.solve(ridge + 2 * s.T @ (s * c), 2 * s.T @ (c[:, 0] * y[active]))
        new = y * (a @ w) < 1
        if (new == active).all():
            break
        active = new
    return w


def stretched(word: str, rng) -> str:
    """The word with one to three characters inserted or doubled."""
    s = list(word)
    for _ in range(int(rng.integers(1, 4))):
        i = int(rng.integers(1, len(s)))
        kind = int(rng.integers(3))
        s.insert(i, "xzq1"[int(rng.integers(4))] if kind == 0 else s[i] if kind == 1 else ".-*_"[int(rng.integers(4))])
    return "".join(s)


def pick_landmarks(toxic: Counter, clean: Counter, n_toxic: int, n_clean: int, count: int, rng) -> list[str]:
    """Half from the words that tell toxic documents, unlike each other; half clean words."""

    def odds(w):
        a, b = toxic[w], clean[w]
        return (math.log((a + 0.5) / (n_toxic + 1)) - math.log((b + 0.5) / (n_clean + 1))) * math.sqrt(a)

    best = sorted(toxic, key=lambda w: (-odds(w), w))[:400]
    k = kernel(best, best)
    # greedy: the word that covers most evidence not covered yet
    gain, covered, chosen = np.array([max(odds(w), 0.0) for w in best]), np.zeros(len(best)), []
    for _ in range(min(count // 2, len(best))):
        worth = (gain * np.maximum(0, k - covered[None, :])).sum(1)
        worth[chosen] = -1
        i = int(worth.argmax())
        chosen.append(i)
        covered = np.maximum(covered, k[i])
    common = sorted(clean, key=lambda w: (-clean[w], w))[:2000]
    some = rng.choice(len(common), min(count - len(chosen), len(common)), replace=False)
    return list(dict.fromkeys([best[i] for i in chosen] + [common[i] for i in sorted(some.tolist())]))


def signature(words: list[str]) -> tuple[int, ...]:
    """Three least hashes of the longer words: equal for copies, and mostly for near copies."""
    return tuple(sorted(zlib.crc32(w.encode()) for w in words if len(w) >= 7)[:3])


def leaning(words: list[str], told: dict) -> np.ndarray:
    """Which words may be what makes documents toxic. told: distinct words by (label, signature)."""
    n = Counter(y for y, _ in told)
    df = {y: Counter(itertools.chain.from_iterable(ws for (label, _), ws in told.items() if label == y)) for y in (0, 1)}
    a, b = (np.array([df[y][w] for w in words], float) for y in (1, 0))
    ratio = (a + 0.5) / (n[1] + 1) / ((b + 0.5) / (n[0] + 1))
    quoted = {w for w, r, x in zip(words, ratio, b) if x and r >= LEAN}
    crowds = [held for (y, _), ws in told.items() if y == 0 and len(held := quoted.intersection(ws)) > max(3, len(ws) // 20)]
    quoted.difference_update(*crowds)
    out = np.array([w in quoted for w in words]) | ((b == 0) & (a > 0))
    if not out.any() and ratio.max() > 1:
        out = ratio == ratio.max()
    return out


def train(bags: list[tuple[int, list[str]]], features) -> Machine | None:
    """bags: (label, distinct words) of the sample documents. ``features(words, landmarks)`` gives their kernel."""
    n = Counter(y for y, _ in bags)
    if not n[0] or not n[1]:
        return None
    rng = np.random.default_rng(SEED)
    # near copies of a document speak once: only the first of those with equal signature counts
    told = {(y, signature(ws)): ws for y, ws in reversed(bags)}
    df = {y: Counter(itertools.chain.from_iterable(ws for (label, _), ws in told.items() if label == y)) for y in (0, 1)}
    for y, ws in bags:
        df[y].update({w: 0 for w in ws})
    if not df[1] or not df[0]:
        return None
    marks = pick_landmarks(df[1], df[0], n[1], n[0], LANDMARKS, rng)
    values, vectors = np.linalg.eigh(kernel(marks, marks).astype(np.float64))
    root = vectors / np.sqrt(np.maximum(values, 1e-3)) @ vectors.T
    words = sorted(set(df[0]) | set(df[1]))
    at = {w: i for i, w in enumerate(words)}
    phi = features(words, marks) @ root
    lean = leaning(words, told)
    toxic_bags = [np.array([at[w] for w in ws], np.int64) for y, ws in bags if y == 1 and ws]
    clean_rows = np.flatnonzero(~lean)
    negatives = rng.choice(clean_rows, min(4000, len(clean_rows)), replace=False)
    # first choice: words that lean to toxic documents, weighted by how many of them have them
    support = np.maximum(np.array([df[1][w] for w in words], float), 1.0)
    found = np.flatnonzero(lean & (support >= (np.quantile(support[lean], 0.98) if lean.any() else 1.0)))
    w = np.zeros(phi.shape[1] + 1)
    for step in range(ROUNDS):
        if not len(found):
            return None
        plain = [words[i] for i in found]
        wider = [stretched(x, rng) for x in plain for _ in range(4)]
        wider = [x[:SPAN] for x in wider]
        x = np.vstack([phi[found], kernel(wider, marks) @ root, phi[negatives]])
        y = np.concatenate([np.ones(len(found) + len(wider)), -np.ones(len(negatives))])
        heavy = np.concatenate([np.sqrt(support[found]), np.repeat(np.sqrt(support[found]) / 4, 4), np.ones(len(negatives))])
        w = solve(x, y, heavy * 4.0)
        f = phi @ w[:-1] + w[-1]
        # again: the worst word of each toxic document, and the clean words nearest the margin
        worst = np.unique([b[f[b].argmax()] for b in toxic_bags])
        sure = np.flatnonzero(lean & (f > 0.5) & (support > 1))
        found = np.union1d(worst[lean[worst]], sure)
        hard = clean_rows[np.argsort(-f[clean_rows])[:2000]]
        negatives = np.union1d(negatives, hard)
    m = Machine(marks, (root @ w[:-1]).astype(np.float32), float(w[-1]))
    # logistic calibration on the documents' worst words
    top = np.array([f[[at[x] for x in ws]].max() if ws else -1.0 for _, ws in bags])
    label = np.array([y for y, _ in bags], float)
    a, b = 4.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * top + b, -50, 50)))
        g = np.array([((p - label) * top).sum() + 1e-2 * a, (p - label).sum() + 1e-2 * b])
        s = p * (1 - p)
        h = np.array([[(s * top * top).sum() + 1e-2, (s * top).sum()], [(s * top).sum(), s.sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
    m.slope, m.offset = float(a), float(b)
    return m


class Scorer:
    def __init__(self, machine: Machine):
        # values of chunks: those met lately, and those met before that
        self.m, self.memo, self.older = machine, {}, {}

    def worst(self, texts: list[str]) -> np.ndarray:
        """Highest decision value over all words of each text."""
        split = [s + spelled(s) + broken(s) for s in map(str.split, texts)]
        if len(self.memo) > MEMO // 2:
            self.memo, self.older = {}, self.memo
        memo, older = self.memo, self.older
        new = [c for c in set(itertools.chain.from_iterable(split)) if c not in memo]
        memo.update((c, older[c]) for c in new if c in older)
        new = [c for c in new if c not in older]
        if new:
            words = [chunk_words(c) for c in new]
            distinct = list(dict.fromkeys(itertools.chain.from_iterable(words)))
            value = dict(zip(distinct, self.m.values(distinct).tolist()))
            memo.update((c, max((value[w] for w in ws), default=-1.0)) for c, ws in zip(new, words))
        return np.array([max(map(memo.__getitem__, s), default=-1.0) for s in split])

    def slices(self, texts: list) -> np.ndarray:
        parts, lo, chars = [], 0, 0
        texts = [t or "" for t in texts]
        for i, t in enumerate(texts):
            if i > lo and chars + len(t) > SLICE_CHARS:
                parts.append(self.worst(texts[lo:i]))
                lo, chars = i, 0
            chars += len(t)
        parts.append(self.worst(texts[lo:]))
        return np.concatenate(parts)


def sentences(text: str) -> list[str]:
    return [s for s in _SENTENCE.split(text) if s.strip()]


def fit(docs: DataFrame, labels: DataFrame) -> Machine | None:
    """A machine from labelled rows of ``docs``; the bounded sample's words reach the driver."""
    spark = docs.sparkSession
    given = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic"))
    n = {r["toxic"]: r["count"] for r in given.groupBy("toxic").count().collect()}
    u = F.pmod(F.xxhash64(F.col("_id"), F.lit(SEED)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.when(F.col("toxic") == 1, F.lit(TRAIN_TOXIC / max(1, n.get(1, 0)))).otherwise(F.lit(TRAIN_CLEAN / max(1, n.get(0, 0))))
    chosen = given.where(u < share)
    short = docs.select(F.col("doc_id"), "text").where(F.length("text") <= TRAIN_CHARS)

    def bag(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            out = []
            for t in b.column("text").to_pylist():
                ws: dict[str, None] = {}
                for s in sentences(t):
                    chunks = s.split()
                    ws.update(dict.fromkeys(itertools.chain.from_iterable(map(chunk_words, chunks))))
                    ws.update(dict.fromkeys(spelled(chunks)))
                ws.update(dict.fromkeys(broken(t.split())))
                out.append(list(ws))
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(out, pa.list_(pa.string()))], ["toxic", "words"])

    # ``chosen`` has about TRAIN_TOXIC + TRAIN_CLEAN rows however many labels there are
    sample = short.join(F.broadcast(chosen), short["doc_id"] == chosen["_id"]).select("toxic", "text")
    got = sample.mapInArrow(bag, "toxic int, words array<string>").toArrow()
    bags = sorted(zip(got.column(0).to_pylist(), got.column(1).to_pylist()))

    def features(words: list[str], marks: list[str]) -> np.ndarray:
        """Kernel of the sample's words with the landmarks, computed by the executors."""

        def run(batches: Iterator[pa.RecordBatch]):
            for b in batches:
                k = kernel(b.column("w").to_pylist(), marks)
                yield pa.RecordBatch.from_arrays([b.column("i"), pa.array([x.tobytes() for x in k], pa.binary())], ["i", "k"])

        frame = spark.createDataFrame(pd.DataFrame({"i": np.arange(len(words)), "w": words}), "i bigint, w string")
        out = frame.repartition(spark.sparkContext.defaultParallelism * 2, "i").mapInArrow(run, "i bigint, k binary").toArrow()
        order = np.argsort(out.column(0).to_numpy())
        k = np.frombuffer(b"".join(out.column(1).to_pylist()), np.float32).reshape(len(words), len(marks))
        return k[order].astype(np.float64)

    return train(bags, features)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted. Learns from rows that are not held out."""
    machine = fit(docs.where(~held_out()), labels.where(~held_out()))
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]):
        m = shared.value
        scorer = Scorer(m) if m else None
        for b in batches:
            texts = b.column("text").to_pylist()
            s = m.probability(scorer.slices(texts)) if m else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64())], ["doc_id", "score"])

    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = d.mapInArrow(run, "doc_id bigint, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))

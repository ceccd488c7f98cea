"""Language identification by interpolated Kneser-Ney character models.

Each language gets a character model of order ``ORDER`` over its words, padded at
the start and closed by a space. Highest-order counts are raw; lower orders count
the distinct characters seen before an n-gram (Kneser-Ney), except for n-grams
that begin with padding; each order has its own absolute discount from its counts
of ones and twos. The interpolated probability of every seen n-gram and the
back-off weight of every seen context lie in arrays sorted by the n-gram's hash,
with a column per language, and are looked up by binary search.

A text's words are scored by every model; the language of least cross-entropy
per predicted character wins. Rejection is calibrated on labelled documents that
were not used for counting: their mean entropy under their own model and under
the best of the other models. A text is rejected if its least entropy has gone
``REJECT_AT`` of the way from the first to the second (plus ``CHAR_SD`` / root of its
length), that is, if the best model fits it like a foreign language. A text with
a foreign passage lies between and stays.

The models are fitted on a bounded sample: about ``TRAIN_DOCS`` documents of each
language for counting and a tenth of that for calibration, chosen by a hash of
doc_id. Scoring reads every whole text; words seen before by the same worker are
not scored again (a memo of at most ``MEMO`` entries).

Defined results: a null text or one without a letter has lang_pred 'und', score
0 and is rejected; rows without lang never teach; with nothing to learn from all
texts are 'und'; ties of entropy go to the first language in code point order; rows
are scored one by one, so repeated rows and null ids do no harm. Only doc_id,
text and lang (for learning) are read.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import packed

ORDER = 5
TRAIN_DOCS = 2_000
#: Share of the way to a foreign language's entropy at which texts are rejected.
REJECT_AT = 0.8
#: Spread in nats of one character's surprise, for short texts.
CHAR_SD = 4.0
MEMO = 300_000
SLICE_CHARS = 2_000_000
#: Words that the models score together.
WORDS_AT_ONCE = 8_192
PAD = "\x02"
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


_LETTERS = regex.compile(r"\p{L}+").findall  # bound once: looking up a pattern takes longer than searching a chunk


def words_of(text: str) -> list[str]:
    """Runs of letters, in lower case."""
    return _LETTERS(text.lower())


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all padded words, and which of them are predicted."""
    pad = PAD * (ORDER - 1)
    joined = "".join(f"{pad}{w} " for w in words)
    cp = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    return cp, cp != ord(PAD)


def _hashes(cp: np.ndarray) -> list[np.ndarray]:
    """[k]: hash of the k characters that end at each place (of what there is at the start)."""
    out, acc, power = [np.zeros(len(cp), np.uint64)], np.zeros(len(cp), np.uint64), np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(1, ORDER + 1):
            shifted = np.zeros(len(cp), np.uint64)
            shifted[k - 1 :] = cp[: len(cp) - k + 1]
            acc = acc + (shifted + np.uint64(1)) * power
            power = power * _STEP
            h = (acc + np.uint64(k)) * _MIX
            h = (h ^ (h >> np.uint64(29))) * _STEP
            out.append(h ^ (h >> np.uint64(32)))
    return out


def gram_hash(grams: list[str]) -> np.ndarray:
    """Hashes of n-grams of one length, as ``_hashes`` has them."""
    k = len(grams[0])
    cp = np.frombuffer("".join(grams).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64).reshape(len(grams), k)
    acc, power = np.zeros(len(grams), np.uint64), np.uint64(1)
    with np.errstate(over="ignore"):
        for j in range(k):
            acc = acc + (cp[:, k - 1 - j] + np.uint64(1)) * power
            power = power * _STEP
        h = (acc + np.uint64(k)) * _MIX
        h = (h ^ (h >> np.uint64(29))) * _STEP
    return h ^ (h >> np.uint64(32))


def kneser_ney(top: dict[str, int], vocabulary: int) -> tuple[list[dict[str, float]], list[dict[str, float]]]:
    """From highest-order counts: per order k, P(last | rest) of seen n-grams and the weight of seen contexts."""
    counts: list[dict[str, int]] = [{} for _ in range(ORDER + 1)]
    counts[ORDER] = top
    raw = top
    for k in range(ORDER - 1, 0, -1):
        seen: Counter = Counter()
        lower_raw: Counter = Counter()
        for g, c in raw.items():
            seen[g[1:]] += 1
            lower_raw[g[1:]] += c
        counts[k] = {g: (lower_raw[g] if g[0] == PAD else n) for g, n in seen.items()}
        raw = lower_raw
    probs: list[dict[str, float]] = [{} for _ in range(ORDER + 1)]
    weights: list[dict[str, float]] = [{} for _ in range(ORDER + 1)]
    for k in range(1, ORDER + 1):
        own = {g: c for g, c in counts[k].items() if g[-1] != PAD}
        ones, twos = sum(c == 1 for c in own.values()), sum(c == 2 for c in own.values())
        discount = ones / (ones + 2 * twos) if ones else 0.5
        total: Counter = Counter()
        kinds: Counter = Counter()
        for g, c in own.items():
            total[g[:-1]] += c
            kinds[g[:-1]] += 1
        weights[k] = {h: discount * kinds[h] / total[h] for h in total}
        for g, c in own.items():
            lower = probs[k - 1].get(g[1:]) if k > 1 else 1.0 / vocabulary
            if lower is None:  # a context seen only behind padding
                lower = 1.0 / vocabulary
            probs[k][g] = max(c - discount, 0.0) / total[g[:-1]] + weights[k][g[:-1]] * lower
    return probs, weights


@dataclass
class Models:
    """Sorted hash arrays of all languages."""

    langs: list[str]
    floor: float
    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    limit: np.ndarray = None

    @classmethod
    def fit(cls, counts: pd.DataFrame) -> Models:
        """counts: lang, gram (of ORDER characters), n."""
        langs = sorted(counts["lang"].unique())
        vocabulary = len({g[-1] for g in counts["gram"]}) + 1
        per = [kneser_ney(dict(zip(c["gram"], c["n"].tolist())), vocabulary) for lang in langs for c in [counts[counts["lang"] == lang]]]
        grams, contexts = [], []
        for k in range(1, ORDER + 1):
            for which, out, length, empty in ((0, grams, k, np.nan), (1, contexts, k - 1, 0.0)):
                keys = sorted(set().union(*(p[which][k] for p in per)))
                if length == 0:  # the empty context
                    out.append((np.zeros(1, np.uint64), np.log([[p[1][1].get("", 1.0) for p in per]])))
                    continue
                table = np.full((len(keys), len(langs)), empty)
                at = {g: i for i, g in enumerate(keys)}
                for col, p in enumerate(per):
                    table[[at[g] for g in p[which][k]], col] = np.log(list(p[which][k].values()))
                h = gram_hash(keys)
                order = np.argsort(h)
                out.append((h[order], table[order].astype(np.float32)))
        return cls(langs, -np.log(vocabulary), grams, contexts)

    def word_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(words x languages) log probabilities, and predicted characters of each word."""
        if not words:
            return np.zeros((0, len(self.langs))), np.zeros(0)
        if len(words) > WORDS_AT_ONCE:  # some ten arrays of 8 bytes a character
            parts = [self.word_scores(words[lo : lo + WORDS_AT_ONCE]) for lo in range(0, len(words), WORDS_AT_ONCE)]
            return np.concatenate([s for s, _ in parts]), np.concatenate([n for _, n in parts])
        cp, predicted = _codes(words)
        hs = _hashes(cp)
        at = np.flatnonzero(predicted)
        score = np.full((len(at), len(self.langs)), self.floor)
        for k in range(1, ORDER + 1):
            (gk, gp), (ck, cw) = self.grams[k - 1], self.contexts[k - 1]
            if k == 1:
                score += cw[0]
            else:
                q = hs[k - 1][at - 1]
                i = np.minimum(np.searchsorted(ck, q), len(ck) - 1)
                score += np.where((ck[i] == q)[:, None], cw[i], 0.0)
            q = hs[k][at]
            i = np.minimum(np.searchsorted(gk, q), len(gk) - 1)
            p = gp[i]
            score = np.where((gk[i] == q)[:, None] & ~np.isnan(p), p, score)
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        return np.add.reduceat(score, starts, axis=0), lengths.astype(float)


class Scorer:
    """Sums of log probabilities of whole texts, with a memo of chunks between spaces."""

    def __init__(self, models: Models):
        self.m, self.memo, self.width = models, {}, len(models.langs) + 1
        self.table = np.zeros((1024, self.width))
        self.used = 0

    def _chunks(self, chunks: list[str]) -> np.ndarray:
        words = [words_of(c) for c in chunks]
        distinct = list(dict.fromkeys(itertools.chain.from_iterable(words)))
        s, n = self.m.word_scores(distinct)
        full = np.column_stack([s, n]) if distinct else np.zeros((0, self.width))
        at = {w: i for i, w in enumerate(distinct)}
        flat = np.fromiter((at[w] for ws in words for w in ws), np.int64)
        owner = np.repeat(np.arange(len(chunks)), [len(w) for w in words])
        out = np.zeros((len(chunks), self.width))
        np.add.at(out, owner, full[flat])
        return out

    def texts(self, texts: list[str]) -> np.ndarray:
        """(texts x languages + 1): log probabilities; predicted characters."""
        split = [t.split() for t in texts]
        flat = list(itertools.chain.from_iterable(split))
        if len(self.memo) > MEMO:
            self.memo, self.used = {}, 0
        new = [c for c in dict.fromkeys(flat) if c not in self.memo]
        if new:
            if self.used + len(new) > len(self.table):
                grown = np.zeros((2 * (self.used + len(new)), self.width))
                grown[: self.used] = self.table[: self.used]
                self.table = grown
            self.table[self.used : self.used + len(new)] = self._chunks(new)
            self.memo.update(zip(new, range(self.used, self.used + len(new))))
            self.used += len(new)
        out = np.zeros((len(texts), self.width))
        sizes = np.array([len(s) for s in split])
        full = np.flatnonzero(sizes)
        if len(full):
            idx = np.fromiter(map(self.memo.__getitem__, flat), np.int64, len(flat))
            starts = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
            out[full] = np.add.reduceat(self.table[idx], starts, axis=0)
        return out

    def slices(self, texts: list | pa.Array) -> np.ndarray:
        """``texts`` in slices of bounded size; of an Arrow array only one slice at a time becomes Python strings."""
        if not isinstance(texts, (pa.Array, pa.ChunkedArray)):
            texts = pa.array(texts, pa.string())
        parts, lo, chars = [], 0, 0
        for i, n in enumerate(pc.fill_null(pc.utf8_length(texts), 0).to_pylist()):
            if i > lo and chars + n > SLICE_CHARS:
                parts.append(self.texts([t or "" for t in texts[lo:i].to_pylist()]))
                lo, chars = i, 0
            chars += n
        parts.append(self.texts([t or "" for t in texts[lo:].to_pylist()]))
        return np.concatenate(parts)


def _hashed(share: float, salt: int) -> Column:
    return F.pmod(F.xxhash64(F.col("doc_id"), F.lit(salt)), F.lit(1 << 30)) < F.lit(int(min(1.0, share) * (1 << 30)))


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Models | None:
    """Models from rows with lang and text; None if there are none. Two bounded results reach the driver."""
    spark = docs.sparkSession
    taught = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["count"] for r in taught.groupBy("lang").count().collect()}  # one row per language
    if not sizes:
        return None
    share = spark.createDataFrame([(k, min(1.0, 1.1 * train_docs / n)) for k, n in sizes.items()], "lang string, share double")
    u = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = taught.join(F.broadcast(share), "lang").where(u < F.col("share")).withColumn("calibrate", u >= F.col("share") * F.lit(1 / 1.1))

    def count(batches: Iterator[pa.RecordBatch]):
        c: Counter = Counter()
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                for w, n in Counter(words_of(text)).items():
                    s = PAD * (ORDER - 1) + w + " "
                    for i in range(len(w) + 1):
                        c[lang, s[i : i + ORDER]] += n
        ks = list(c)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in ks], pa.string()), pa.array([k[1] for k in ks], pa.string()), pa.array(list(c.values()), pa.int64())], ["lang", "gram", "n"])

    counted = sample.where("NOT calibrate").select("lang", "text").mapInArrow(count, "lang string, gram string, n bigint")
    counts = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    if counts.empty:
        return None
    models = Models.fit(counts)
    shared = spark.sparkContext.broadcast(models)

    def entropies(batches: Iterator[pa.RecordBatch]):
        scorer = Scorer(shared.value)
        at = {x: i for i, x in enumerate(shared.value.langs)}
        for b in batches:
            langs = b.column("lang").to_pylist()
            s = scorer.slices(b.column("text"))
            ok = [i for i, lang in enumerate(langs) if lang in at and s[i, -1] > 0]
            own = [-s[i, at[langs[i]]] / s[i, -1] for i in ok]
            # of one language alone: as if drawn evenly from its characters
            other = [min([-s[i, j] / s[i, -1] for x, j in at.items() if x != langs[i]], default=-shared.value.floor) for i in ok]
            yield pa.RecordBatch.from_arrays([pa.array([langs[i] for i in ok], pa.string()), pa.array(own, pa.float64()), pa.array(other, pa.float64())], ["lang", "own", "other"])

    c = sample.where("calibrate").select("lang", "text").mapInArrow(entropies, "lang string, own double, other double")
    got = {r["lang"]: r["own"] + REJECT_AT * (r["other"] - r["own"]) for r in c.groupBy("lang").agg(F.avg("own").alias("own"), F.avg("other").alias("other")).collect()}
    models.limit = np.array([got.get(x, np.inf) for x in models.langs])
    return models


def scored(models: Models | None, scores: np.ndarray) -> pd.DataFrame:
    """lang_pred, score, entropy, rejected of summed scores."""
    n = len(scores)
    none = pd.DataFrame({"lang_pred": ["und"] * n, "score": np.zeros(n), "entropy": np.full(n, np.nan), "rejected": np.ones(n, bool)})
    if models is None or n == 0:
        return none
    chars = scores[:, -1]
    some = chars > 0
    h = -scores[:, :-1] / np.maximum(chars, 1)[:, None]
    best = h.argmin(1)
    least = h[np.arange(n), best]
    # evidence of at most 50 characters: characters of a text are not independent
    weight = np.exp(-(h - least[:, None]) * np.minimum(chars, 50)[:, None]).sum(1)
    limit = models.limit[best] + CHAR_SD / np.sqrt(np.maximum(chars, 1))
    names = np.array(models.langs, object)
    none["lang_pred"] = np.where(some, names[best], "und")
    none["score"] = np.where(some, 1 / weight, 0.0)
    none["entropy"] = np.where(some, least, np.nan)
    none["rejected"] = ~some | (least > limit)
    return none


def predictor(spark, models: Models | None):
    """A column function: text -> struct<lang_pred, score, entropy, rejected>."""
    shared = spark.sparkContext.broadcast(models)

    # Arrow arrays, not pandas: a batch of whole texts is not copied into Python strings at once
    @F.arrow_udf("lang_pred string, score double, entropy double, rejected boolean")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        scorer = Scorer(m) if m else None
        for texts in batches:
            told = scored(m, scorer.slices(texts) if m else np.zeros((len(texts), 1)))
            cols = [pa.array(told["lang_pred"], pa.string())] + [pa.array(told[c].to_numpy()) for c in ("score", "entropy", "rejected")]
            yield pa.StructArray.from_arrays(cols, ["lang_pred", "score", "entropy", "rejected"])

    return predict.asNondeterministic()  # so that it runs once per row


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def predictions(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score, entropy, rejected."""
    models = fit(docs.where(~held_out() & F.col("doc_id").isNotNull()), train_docs)
    p = predictor(docs.sparkSession, models)
    return docs.select("doc_id", held_out().alias("held_out"), p(F.col("text").cast("string")).alias("p")).select("doc_id", "held_out", "p.*")


def keep_recognised(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """``docs`` without the rows whose language is rejected."""
    models = fit(docs.where(~held_out() & F.col("doc_id").isNotNull()), train_docs)
    p = predictor(docs.sparkSession, models)
    return packed(docs, told=p(F.col("text").cast("string"))).where("NOT told.rejected").select("_row.*")

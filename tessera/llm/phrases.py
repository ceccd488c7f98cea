"""Phrase collocations by Toivonen's sampling algorithm.

A sample of the documents is mined at a lowered threshold; it proposes phrases S.
One pass over all documents counts S and its negative border exactly: every word,
and every phrase whose first and last part of one word less both lie in S. A border
phrase that reaches the threshold is a failure of the sample; failures join S, and
a further pass counts what the larger S lets in and the passes before did not. When
no failure of fewer than ``max_words`` words is left, S is closed and every phrase
that reaches the threshold has been counted: all its parts are as frequent, so
they are in S, and the phrase was let in.

S grows with the corpus, so tasks get it as a table of ``FILTER_BITS`` bits (8 MB
at every size), built by Spark's bitmap aggregate over hashes of the phrases. A bit
set by another phrase only lets more phrases be counted. Texts are cut into words and
numbered once, as blocks of bounded bytes in the shared checkpoint folder; passes read those. Which phrases a pass counts
is a function of the bits, so "counted before" is known exactly in the next pass
and counts of passes never overlap. Phrases are counted as numbers inside a block
in numpy. A pass first sums counts by 44 bits of the hash, in sorted buckets of 4 bytes a
phrase: phrases of one hash share a sum, so it is never too low, and what stays under the
threshold, nearly all of the border, needs no text. The others are then summed by text (no hash decides equality) with partial aggregation: a word of any frequency is one row per block.

The sample takes documents by a hash of id and text, a share of the corpus that
grows with it; results do not depend on which documents it takes.

Scores: a candidate (2 to 4 words, a >= 30) is cut after each of its first words;
the cut of the least floor(2000000 a / (l + r)) counts, ties to the earliest, in
decimals of 38 digits. Candidates go if a longer candidate that contains them, dropped or not, has at
least 80 % of their count.

Defined results: a null text has no words; a null lang is 'und' (and joins a lang of
that name); A-Z are lower-cased, nothing else; white space other than space and tab
ends a piece (LF, VT, FF, CR) or belongs to words. Repeated rows count as often as they
stand. An empty table gives no rows. Only doc_id, text and lang are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut_lineage

MIN_COUNT = 30
MAX_WORDS = 4
TOP = 2000
SCALE = 2_000_000
#: A candidate goes if a longer one around it has at least this percentage of its count.
COVERED_PERCENT = 80
#: Share of the documents in the sample, and by how much its threshold is lowered.
SAMPLE_SHARE = 0.2
LOWERED = 0.6
#: Bits of the table of phrases that passes consult; a power of 2.
FILTER_BITS = 1 << 26
#: Bytes of text that are counted together in a task.
BLOCK_BYTES = 3 << 20
#: Rows of a batch that a task sends.
ROWS_OUT = 100_000
#: Counts by hash are shuffled in 2 to this power buckets; bits of a hash beyond these and 32 more do not count.
BUCKET_BITS = 12
#: Counts by hash that a task holds before it sends them.
KEYS_HELD = 1 << 21
#: Window buckets of the first of two rankings.
RANK_BUCKETS = 64

#: A piece ends at these bytes; "." stands for all of them.
ENDS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + ENDS, b"abcdefghijklmnopqrstuvwxyz " + b"." * len(ENDS))
_BUCKET = 32768  # bits in one value of Spark's bitmap aggregate
BLOCK_NAMES = ["drawn", "a", "words", "hashes", "lang_of", "langs"]
PACKED = "drawn boolean, a binary, words binary, hashes binary, lang_of binary, langs array<string>"
COUNTED = "lang string, phrase string, h bigint, known boolean, f bigint"


# --- one block of texts in a task -------------------------------------------


class Numbers(dict):
    """Word of one language -> its number in the block."""

    def __init__(self, block: "Block", lang: str):
        super().__init__({b".": 0})
        self.block, self.lang, self.seed = block, len(block.langs), xxhash.xxh64_intdigest(lang.encode())
        block.langs.append(lang)

    def __missing__(self, word: bytes) -> int:
        b = self.block
        self[word] = n = len(b.words)
        b.words.append(word)
        b.hashes.append(xxhash.xxh64_intdigest(word, self.seed))
        b.lang_of.append(self.lang)
        return n


def _joined(h: np.ndarray, last: np.ndarray) -> np.ndarray:
    x = h * np.uint64(0x9E3779B97F4A7C15) + last
    x ^= x >> np.uint64(31)
    return x * np.uint64(0xD6E8FEB86659FD93)


def _inside(bits: np.ndarray | None, h: np.ndarray) -> np.ndarray:
    if bits is None:
        return np.zeros(len(h), bool)
    at = h & np.uint64(len(bits) * 8 - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


class Block:
    """Words of some texts as numbers; 0 stands between pieces."""

    def __init__(self):
        self.words, self.hashes, self.lang_of = [b"."], [0], [0]
        self.langs: list[str] = []
        self.numbers: dict[str, Numbers] = {}
        self.parts: list[np.ndarray] = []
        self.n_bytes = 0

    def add(self, lang: str, piece: bytes) -> None:
        if lang not in self.numbers:
            self.numbers[lang] = Numbers(self, lang)
        tokens = piece.replace(b".", b" . ").split()
        if tokens:
            self.parts.append(np.fromiter(map(self.numbers[lang].__getitem__, tokens), np.int64, len(tokens)))
            self.parts.append(np.zeros(1, np.int64))
        self.n_bytes += len(piece)

    def packed(self, drawn: bool) -> pa.RecordBatch:
        """The block as one row."""
        a = np.concatenate(self.parts).astype(np.int32)
        cols = [
            pa.array([drawn]), pa.array([a.tobytes()], pa.binary()), pa.array([b" ".join(self.words)], pa.binary()),
            pa.array([np.array(self.hashes, np.uint64).tobytes()], pa.binary()), pa.array([np.array(self.lang_of, np.int32).tobytes()], pa.binary()), pa.array([self.langs], pa.list_(pa.string())),
        ]
        return pa.RecordBatch.from_arrays(cols, BLOCK_NAMES)


def levels(row: dict, now: np.ndarray | None, before: np.ndarray | None, max_words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per number of words m from 2: (m, hash of the m words at each place, places that ``now`` lets in and ``before`` did not)."""
    a, h1 = np.frombuffer(row["a"], np.int32), np.frombuffer(row["hashes"], np.uint64)
    now_word, old_word = _inside(now, h1), _inside(before, h1)
    now_word[0] = old_word[0] = False  # no phrase goes over the end of a piece
    h, let, old = h1[a], now_word[a], old_word[a]
    for m in range(2, max_words + 1):
        let, old = let[:-1] & let[1:], old[:-1] & old[1:]
        if not let.any():
            return
        h = _joined(h[:-1], h1[a[m - 1 :]])
        yield m, h, np.flatnonzero(let & ~old)
        let = let & _inside(now, h)
        old = old & _inside(before, h)


def phrase_rows(row: dict, now: np.ndarray | None, before: np.ndarray | None, passing: np.ndarray | None, first: bool, max_words: int) -> Iterator[pa.RecordBatch]:
    """Counts by text of what ``now`` lets in and ``before`` did not (``first``: no pass was before) in a packed block;
    of phrases of two words and more only those whose hash is in ``passing``."""
    a, lang_of = np.frombuffer(row["a"], np.int32), np.frombuffer(row["lang_of"], np.int32)
    words, langs = pa.array(row["words"].split(b" "), pa.binary()).cast(pa.string()), pa.array(row["langs"], pa.string())

    def batch(index: list[np.ndarray], h, f):
        known = _inside(now, h)
        h = np.where(known, np.uint64(0), h)  # only hashes of failures are read; zeros shuffle as next to nothing
        for lo in range(0, len(f), ROWS_OUT):
            part = slice(lo, lo + ROWS_OUT)
            parts = [words.take(pa.array(c[part])) for c in index]
            phrase = parts[0] if len(parts) == 1 else pc.binary_join_element_wise(*parts, " ")
            cols = [langs.take(pa.array(lang_of[index[0][part]])), phrase, pa.array(h[part].view(np.int64)), pa.array(known[part]), pa.array(f[part])]
            yield pa.RecordBatch.from_arrays(cols, ["lang", "phrase", "h", "known", "f"])

    if first:
        f = np.bincount(a, minlength=len(words))
        yield from batch([np.arange(1, len(words))], np.frombuffer(row["hashes"], np.uint64)[1:], f[1:])
        total = np.bincount(lang_of[1:], weights=f[1:], minlength=len(langs)).astype(np.int64)
        k = len(langs)  # words of each language, under the empty phrase
        yield pa.RecordBatch.from_arrays([langs, pa.array([""] * k), pa.array(np.zeros(k, np.int64)), pa.array(np.ones(k, bool)), pa.array(total)], ["lang", "phrase", "h", "known", "f"])
    for m, h, places in levels(row, now, before, max_words):
        places = places[_inside(passing, h[places])]
        if not len(places):
            continue
        # equal phrases stand side by side in the order of hashes; a row ends where a word changes, so
        # that phrases of one hash are never taken for one (at worst they get several rows each)
        places = places[np.argsort(h[places])]
        at = [a[places + k] for k in range(m)]
        starts = np.flatnonzero(np.concatenate([[True], reduce(np.logical_or, [c[1:] != c[:-1] for c in at])]))
        yield from batch([c[starts] for c in at], h[places[starts]], np.diff(np.append(starts, len(places))))


# --- counts by hash ------------------------------------------------------------


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    k, c = np.concatenate(keys), np.concatenate(counts)
    if not len(k):
        return k, c
    order = np.argsort(k)
    k = k[order]
    starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[starts], np.add.reduceat(c[order], starts)


def hash_buckets(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Sorted keys (of ``BUCKET_BITS`` + 32 bits) as a row per bucket: the low 32 bits and the counts of its keys."""
    bounds = np.searchsorted(keys, np.arange((1 << BUCKET_BITS) + 1, dtype=np.uint64) << np.uint64(32))
    some = np.flatnonzero(np.diff(bounds))
    offsets = pa.py_buffer((np.append(bounds[some], len(keys)) * 4).astype(np.int32))

    def cut(values):
        return pa.Array.from_buffers(pa.binary(), len(some), [None, offsets, pa.py_buffer(values)])

    cols = [pa.array(some.astype(np.int32)), cut(keys.astype(np.uint32)), cut(counts.astype(np.int32))]
    return pa.RecordBatch.from_arrays(cols, ["bucket", "k", "n"])


def counted_hashes(blocks: DataFrame, shared: Broadcast, max_words: int, min_count: int) -> DataFrame:
    """h: hashes of the phrases that a pass lets in whose counts sum to ``min_count`` or more; h has ``BUCKET_BITS`` + 32 bits.

    A shuffled row is a bucket of sorted keys of a few blocks, some 4 bytes a phrase, and a bucket is summed in numpy.
    """
    mask = np.uint64((1 << (BUCKET_BITS + 32)) - 1)

    def run(batches: Iterator[pa.RecordBatch]):
        tables = [None if b is None else np.frombuffer(zlib.decompress(b), np.uint8) for b in shared.value[:2]]
        keys, counts = [], []
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(c)[i].as_py() for c in ("a", "hashes")}
                for _, h, places in levels(row, *tables, max_words):
                    k, n = np.unique(h[places] & mask, return_counts=True)
                    keys.append(k)
                    counts.append(n)
                if sum(map(len, keys)) > KEYS_HELD:
                    yield hash_buckets(*_summed(keys, counts))
                    keys, counts = [], []
        if keys:
            yield hash_buckets(*_summed(keys, counts))

    def frequent(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for bucket, ks, ns in zip(*(b.column(c).to_pylist() for c in ("bucket", "ks", "ns"))):
                k, n = _summed([np.frombuffer(x, np.uint32) for x in ks], [np.frombuffer(x, np.int32).astype(np.int64) for x in ns])
                h = k[n >= min_count].astype(np.int64) | (bucket << 32)
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64())], ["h"])

    parts = blocks.select("a", "hashes").mapInArrow(run, "bucket int, k binary, n binary")
    return parts.groupBy("bucket").agg(F.collect_list("k").alias("ks"), F.collect_list("n").alias("ns")).mapInArrow(frequent, "h bigint")


def _pieces(raw: bytes) -> Iterator[bytes]:
    """The text, cut at ends of pieces where it is longer than a block."""
    text = raw.translate(_TABLE)
    while len(text) > BLOCK_BYTES:
        cut = text.rfind(b".", 0, BLOCK_BYTES)
        cut = text.find(b".", BLOCK_BYTES) if cut < 0 else cut
        if cut < 0:
            break
        yield text[:cut]
        text = text[cut + 1 :]
    yield text


# --- passes -------------------------------------------------------------------


def numbered_blocks(docs: DataFrame) -> DataFrame:
    """``docs`` (lang, raw, drawn) as blocks of numbers: texts are read and cut once, all passes count from these.

    Drawn documents (the sample) and the others go to blocks of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        open_blocks = {True: Block(), False: Block()}
        for b in batches:
            langs, texts, drawn = b.column("lang"), b.column("raw"), b.column("drawn")
            for i in range(b.num_rows):
                lang, d = langs[i].as_py(), drawn[i].as_py()
                for piece in _pieces(texts[i].as_py()):
                    block = open_blocks[d]
                    block.add(lang, piece)
                    if block.n_bytes >= BLOCK_BYTES:
                        if block.parts:
                            yield block.packed(d)
                        open_blocks[d] = Block()
        for d, block in open_blocks.items():
            if block.parts:
                yield block.packed(d)

    return cut_lineage(docs.select("lang", "raw", "drawn").mapInArrow(run, PACKED))


def counted(blocks: DataFrame, shared: Broadcast, first: bool, max_words: int) -> DataFrame:
    """One pass over ``blocks`` by text: lang, phrase, h (0 if known), known, f. ``shared``: the three packed tables."""

    def run(batches: Iterator[pa.RecordBatch]):
        tables = [None if b is None else np.frombuffer(zlib.decompress(b), np.uint8) for b in shared.value]
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(c)[i].as_py() for c in BLOCK_NAMES[1:]}
                yield from phrase_rows(row, *tables, first, max_words)

    got = blocks.mapInArrow(run, COUNTED)
    return got.groupBy("lang", "phrase").agg(F.max("h").alias("h"), F.max("known").alias("known"), F.sum("f").alias("f"))


def _words(phrase: str | Column) -> Column:
    return F.split(phrase, " ")


def bits_of(phrases: DataFrame) -> bytes | None:
    """The table of bits of ``phrases`` (h); None without any. At most FILTER_BITS bits come to the driver, whatever the rows."""
    at = phrases.select((F.col("h").bitwiseAND(F.lit(FILTER_BITS - 1)) + 1).alias("at"))
    got = at.groupBy(F.bitmap_bucket_number("at").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    if not got:
        return None
    table = bytearray(FILTER_BITS // 8)
    for r in got:
        lo = (r["b"] - 1) * _BUCKET // 8
        part = bytes(r["bits"])
        end = min(lo + len(part), len(table))
        table[lo:end] = part[: end - lo]
    return bytes(table)


def _either(a: bytes | None, b: bytes) -> bytes:
    return b if a is None else np.bitwise_or(np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)).tobytes()


def _sent(spark, *tables: bytes | None) -> Broadcast:
    """Tables for the tasks of one pass; those of few phrases pack to little, and a pass is over when they are dropped."""
    return spark.sparkContext.broadcast([None if t is None else zlib.compress(t, 1) for t in tables])


@contextmanager
def one_block_a_batch(spark):
    """Hand Python one block at a time: batches of the usual number of rows would hold dozens of blocks."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, "1")
    try:
        yield
    finally:
        spark.conf.set(key, old)


def closed(blocks: DataFrame, min_count: int, max_words: int, proposed: bytes | None) -> tuple[DataFrame, bytes | None, int]:
    """Passes from ``proposed`` until no border phrase fails: all phrases of at least
    ``min_count`` (lang, phrase, f; words of a language under the empty phrase), the table, the number of passes."""
    now, before, parts = proposed, None, []
    while True:
        spark, first = blocks.sparkSession, not parts
        with one_block_a_batch(spark):
            # most border phrases are rare: counts of hashes, never too low, leave few of them to be counted by text
            shared = _sent(spark, now, before, None)
            passing = bits_of(counted_hashes(blocks, shared, max_words, min_count))
            shared.destroy()
            shared = _sent(spark, now, before, passing)
            got = cut_lineage(counted(blocks, shared, first, max_words).where((F.col("f") >= min_count) | (F.col("phrase") == "")))
            shared.destroy()
        parts.append(got)
        failed = bits_of(got.where(~F.col("known") & (F.size(_words("phrase")) < max_words)))
        if failed is None:
            return reduce(DataFrame.unionByName, parts).select("lang", "phrase", "f"), now, len(parts)
        now, before = _either(now, failed), now


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, sample_share: float = SAMPLE_SHARE) -> DataFrame:
    """lang, phrase, f of every phrase of 1 to ``max_words`` words with f >= ``min_count``, and the number of words of
    each lang under the empty phrase."""
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    scale = 1 << 30
    drawn = F.pmod(F.xxhash64("doc_id", raw), F.lit(scale)) < F.lit(int(sample_share * scale))
    blocks = numbered_blocks(docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), raw.alias("raw"), drawn.alias("drawn")))
    lowered = max(2, int(min_count * sample_share * LOWERED))
    _, proposed, _ = closed(blocks.where("drawn"), lowered, max_words, None)
    return closed(blocks, min_count, max_words, proposed)[0]


# --- scores ---------------------------------------------------------------------


def _wide(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(20,0)")


def scored(counts: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """Candidates with their deciding cut, covered ones dropped: lang, phrase, a, l, r, score."""
    phrases = counts.where("phrase <> ''")
    part = phrases.select("lang", F.col("phrase").alias("part"), F.col("f").alias("pf"))
    c = phrases.where(F.col("f") >= min_count).withColumn("w", _words("phrase")).where(F.size("w") > 1).withColumnRenamed("f", "a")

    def words(lo, n):
        return F.array_join(F.slice("w", lo, n), " ")

    cuts = c.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", words(F.lit(1), F.col("k")).alias("head"), words(F.col("k") + 1, F.size("w") - F.col("k")).alias("rest"))
    for side, name in (("head", "l"), ("rest", "r")):
        cuts = cuts.join(part.select(F.col("lang"), F.col("part").alias(side), F.col("pf").alias(name)), ["lang", side])
    score = F.call_function("div", _wide("a") * F.lit(SCALE).cast("decimal(8,0)"), _wide("l") + _wide("r"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "l", "r", "a")).alias("m"))
    best = best.select("lang", "phrase", "m.a", "m.l", "m.r", "m.score")
    # every proper part of two words or more of a longer candidate, with the largest count around it
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))))
    around = c.where(F.size("w") > 2).select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), "a")
    around = around.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(around, ["lang", "phrase"], "left")
    return kept.where(F.col("longer").isNull() | (_wide("longer") * 100 < _wide("a") * COVERED_PERCENT)).drop("longer")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP, sample_share: float = SAMPLE_SHARE) -> DataFrame:
    """The first ``top`` collocations of each language: lang, rank, phrase, a, l, r, n, score."""
    counts = frequent_phrases(docs, min_count, max_words, sample_share)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # two rankings, so that no task sorts all candidates of a language
    s = scored(counts, min_count).withColumn("b", F.pmod(F.xxhash64("phrase"), F.lit(RANK_BUCKETS)))
    s = s.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "b").orderBy(*order))).where(F.col("rank") <= top)
    s = s.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    n = counts.where("phrase = ''").groupBy("lang").agg(F.sum("f").alias("n"))
    return s.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

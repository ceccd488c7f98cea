"""Byte-level BPE encoding and decoding.

The frequent words are merged in Spark expressions: for each a higher-order ``aggregate``
folds the merge of least rank (leftmost of equals) over the word's array of bytes
until none is left. The ranks are a literal map from pairs of pieces to the rank,
which is also the id, of the joined piece; it is laid out as a perfect hash in two
arrays, since a lookup in Spark's own map type walks through its entries. The arrays
are a literal table of one row, which is broadcast: as literals of an expression they
were boxed in every task and printed with every plan. Decoding concatenates the binary
pieces of the ids.

Texts are cut into words by the tokenizer's pattern in Arrow batches, and a row
holds a block of documents as ids, with placeholders for words that still have to
be merged, and the distinct ones of these, so that words are merged in place, those of
one length together in numpy (``pair_merge``): nothing is shuffled. Words that are frequent in a bounded sample of documents
(``SAMPLE_DOCS``, ``CACHED_WORDS``) are folded once beforehand and handed to all
tasks; this only saves work, all other words are merged where they occur and
results do not depend on the sample.

Either way a word takes time in the square of its length; words of more than
``FOLD_BYTES`` bytes (runs of hundreds of letters) are merged in the task by a
heap with the same ranks and the same result.

Defined results: a null text counts as empty; an empty text has 0 tokens and the
digests of the empty string; rows are handled one by one, so nulls, ties and
repeated doc_ids do no harm; an empty table gives an empty result. Only doc_id
and text are read.
"""

from __future__ import annotations

import base64
import heapq
import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.pair_merge import PairRanks, merge_words

FOLD_BYTES = 256
SAMPLE_DOCS = 30_000
CACHED_WORDS = 400_000
#: Characters of text in a block of documents.
BLOCK_CHARS = 3_000_000
#: Chunks a worker remembers.
MEMO = 150_000
#: Rank of a pair that is no token; ids and ranks have ``BITS`` bits.
BITS = 20
NONE = 1 << 30


def load_ranks(path: str | None = None) -> dict[bytes, int]:
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


# --- the literal rank map -------------------------------------------------


def _place(hashes: np.ndarray, slots: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and displace: (shift per bucket, index of the key in each slot or -1).

    A key's bucket is its hash modulo ``buckets``; its slot is the upper hash
    half plus the bucket's shift times an odd step, modulo ``slots`` (a power of 2).
    """
    bucket, base, step = hashes % buckets, (hashes >> 20) & (slots - 1), ((hashes >> 40) & (slots - 1)) | 1
    table, shift = np.full(slots, -1, np.int64), np.zeros(buckets, np.int64)
    order = np.argsort(bucket, kind="stable")
    ends = np.cumsum(np.bincount(bucket, minlength=buckets))
    for b in np.argsort(-np.bincount(bucket, minlength=buckets), kind="stable").tolist():
        keys = order[ends[b - 1] if b else 0 : ends[b]]
        for d in range(1 << 20):
            at = (base[keys] + d * step[keys]) & (slots - 1)
            if len(np.unique(at)) == len(at) and (table[at] < 0).all():
                table[at], shift[b] = keys, d
                break
        else:
            raise ValueError("no perfect hash found")
    return shift, table


def let(value: Column, use) -> Column:
    """``use(value)`` with the value taken once: a lambda's argument is not copied into its body."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


class RankMap:
    """A literal map (left id, right id) -> rank of the joined token, and the fold over it."""

    def __init__(self, spark, ranks: dict[bytes, int]):
        if set(ranks.values()) != set(range(len(ranks))) or len(ranks) >= 1 << BITS:
            raise ValueError("ranks must be 0..n-1")
        pairs = {(ranks[t[:i]] << BITS) | ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        #: the same for ``merge_words``; a rank is the id of what the pair becomes
        self.pairs = {(k >> BITS) << 32 | k & ((1 << BITS) - 1): r << 32 | r for k, r in pairs.items()}
        keys = np.array(list(pairs), np.int64)
        # Spark's own hash, so that driver and expression agree
        got = spark.createDataFrame(pa.table({"k": keys})).select("k", F.shiftrightunsigned(F.xxhash64("k"), 1).alias("h")).toArrow()
        keys = got["k"].to_numpy()
        self.slots, self.buckets = 1 << max(1, (2 * len(keys) - 1).bit_length()), max(1, len(keys) // 3)
        shift, place = _place(got["h"].to_numpy(), self.slots, self.buckets)
        both = (keys << BITS) | np.array([pairs[k] for k in keys.tolist()], np.int64)
        table = np.where(place >= 0, both[place], -1)
        single = [ranks[bytes([b])] for b in range(256)]
        # elements of all pairs of bytes, so that a fold starts without hashing
        two = [(pairs.get((a << BITS) | b, NONE) << BITS) | a for a in single for b in single]

        # one row of four arrays
        arrays = {"shift": (shift, pa.int32()), "table": (table, pa.int64()), "single": (single, pa.int64()), "two": (two, pa.int64())}
        self.row = spark.createDataFrame(pa.table({f"_{n}": pa.array([np.asarray(v)], pa.list_(kind)) for n, (v, kind) in arrays.items()}))

    def element(self, m: Column, left: Column, right: Column) -> Column:
        """Rank of the pair in the upper bits, id of its left piece in the lower ones."""
        mask, key = F.lit(self.slots - 1), F.shiftleft(left, BITS).bitwiseOR(right)

        def slot(h):
            step = F.shiftright(h, 40).bitwiseAND(mask).bitwiseOR(F.lit(1))
            return (F.shiftright(h, 20).bitwiseAND(mask) + F.get(m["shift"], (h % self.buckets).cast("int")) * step).bitwiseAND(mask).cast("int")

        found = let(F.shiftrightunsigned(F.xxhash64(key), 1), lambda h: F.get(m["table"], slot(h)))
        rank = let(found, lambda v: F.when(F.shiftright(v, BITS) == key, v.bitwiseAND(F.lit((1 << BITS) - 1))).otherwise(F.lit(NONE)))
        return F.shiftleft(rank.cast("bigint"), BITS).bitwiseOR(left)

    def alone(self, left: Column) -> Column:
        return F.lit(NONE << BITS).bitwiseOR(left)

    def encode(self, m: Column, word: Column) -> Column:
        """Ids of a word given as its array of byte values: array<int>."""
        low = F.lit((1 << BITS) - 1)

        def ident(e):
            return e.bitwiseAND(low)

        def first(b, i):
            return F.when(i + 1 < F.size(word), F.get(m["two"], F.shiftleft(b, 8) + F.get(word, i + 1))).otherwise(self.alone(F.get(m["single"], b)))

        start = F.transform(word, first)

        def step(acc, _):  # equal elements are equal pairs, so the first of the least ones is the leftmost
            return let(F.array_min(acc), lambda e: F.when(e < F.lit(NONE << BITS), merge(acc, F.shiftright(e, BITS), F.array_position(acc, e).cast("int"))).otherwise(acc))

        def merge(acc, new, place):  # the joined piece's id is the pair's rank; place: of the left piece, from 1
            def at(k):
                before = F.when(k > 1, F.array(self.element(m, ident(F.get(acc, k - 2)), new))).otherwise(F.array().cast("array<bigint>"))
                here = F.when(k + 1 < F.size(acc), self.element(m, new, ident(F.get(acc, k + 1)))).otherwise(self.alone(new))
                return F.concat(F.slice(acc, F.lit(1), F.greatest(k - 2, F.lit(0))), before, F.array(here), F.slice(acc, k + 2, F.size(acc)))

            return let(place, at)

        folded = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(word) - 1, F.lit(1))), start, step)
        return F.transform(folded, lambda e: ident(e).cast("int"))

    def encode_all(self, rows: DataFrame, raw: str, name: str) -> DataFrame:
        """``rows`` with ids of the words in column ``raw``, which goes, as column ``name``."""
        m = F.struct(*[F.col(c).alias(c[1:]) for c in self.row.columns])
        ids = let(m, lambda m: F.transform(F.col(raw), lambda w: self.encode(m, w)))
        return rows.crossJoin(F.broadcast(self.row)).select(*[c for c in rows.columns if c != raw], ids.alias(name))


def heap_encode(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for one long word in n log n steps."""
    n = len(word)
    end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, e = heapq.heappop(heap)
        j = end[i]
        if not alive[i] or j >= n or end[j] != e:
            continue
        alive[j], end[i] = False, e
        if e < n:
            before[e] = i
            if (r := ranks.get(word[i : end[e]])) is not None:
                heapq.heappush(heap, (r, i, end[e]))
        if (b := before[i]) >= 0 and (r := ranks.get(word[b:e])) is not None:
            heapq.heappush(heap, (r, b, e))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


# --- texts to words and back ------------------------------------------------


#: A placeholder's bytes.
_GAP = struct.Struct("=i").pack


class Odd(Exception):
    """A chunk that cannot be cut by itself."""


class Chunks(dict):
    """Chunk (what follows a space up to the next one) -> its ids, packed.

    A chunk that neither begins nor ends with white space is cut by the pattern
    like the same stretch of the whole text. Words not known yet get placeholders
    -1, -2, ...; chunks with such are forgotten at the end of a block.
    """

    def __init__(self, known: dict[str, bytes], pattern: str):
        super().__init__()
        self.known, self.find = known, regex.compile(pattern).findall
        self.plain = pattern == default_pattern()  # whose words of letters alone need no search
        self.lack: dict[str, int] = {}
        self.passing: list[str] = []

    def words(self, words: list[str]) -> tuple[bytes, bool]:
        """Ids of words, and whether all are known."""
        parts, lack = list(map(self.known.get, words)), self.lack
        if None not in parts:
            return b"".join(parts), True
        for i, p in enumerate(parts):
            if p is None:
                parts[i] = _GAP(-1 - lack.setdefault(words[i], len(lack)))
        return b"".join(parts), False

    def __missing__(self, chunk: str) -> bytes:
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise Odd
        if self.plain and chunk.isalpha():
            words = [" " + chunk]
        elif self.plain and chunk[-1] in ".," and chunk[:-1].isalpha():
            words = [" " + chunk[:-1], chunk[-1]]
        else:
            words = self.find(" " + chunk)
        got, known = self.words(words)
        self[chunk] = got
        if not known or len(self) > MEMO:
            self.passing.append(chunk)
        return got

    def text(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        try:
            if first[-1:].isspace():
                raise Odd
            return self.words(self.find(first))[0] + b"".join(map(self.__getitem__, rest))
        except Odd:
            return self.words(self.find(text))[0]

    def end_block(self) -> list[str]:
        words = list(self.lack)
        for c in self.passing:
            del self[c]
        self.lack, self.passing = {}, []
        return words


def fill(packed: bytes, folded: list[bytes]) -> list[int]:
    """Ids with the placeholders replaced."""
    a = np.frombuffer(packed, np.int32)
    gaps = np.flatnonzero(a < 0)
    if not len(gaps):
        return a.tolist()
    parts, at = [], 0
    for g, k in zip(gaps.tolist(), (-1 - a[gaps]).tolist()):
        parts += packed[4 * at : 4 * g], folded[k]
        at = g + 1
    parts.append(packed[4 * at :])
    return np.frombuffer(b"".join(parts), np.int32).tolist()


def frequent_words(docs: DataFrame, ranks: RankMap, pattern: str, sample_docs: int, n_words: int) -> bytes:
    """The most frequent words of a sample of documents, encoded; at most ``n_words`` entries of an Arrow stream."""

    def cut(batches: Iterator[pa.RecordBatch]):
        find = regex.compile(pattern).findall
        for b in batches:
            c: Counter = Counter()
            for t in b.column("text").to_pylist():
                c.update(find(t))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["word", "n"])

    share = min(1.0, sample_docs / max(1, docs.count()))
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select("text")
    counts = sample.mapInArrow(cut, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    top = counts.where(F.octet_length("word") <= FOLD_BYTES).orderBy(F.col("n").desc(), "word").limit(n_words).select("word")

    def as_bytes(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            words = b.column("word").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([words], pa.list_(pa.string())), pa.array([[list(w.encode()) for w in words]], pa.list_(pa.list_(pa.int32())))], ["words", "raw"])

    cores = docs.sparkSession.sparkContext.defaultParallelism
    packed = top.repartition(cores * 4, "word").mapInArrow(as_bytes, "words array<string>, raw array<array<int>>")
    got = ranks.encode_all(packed, "raw", "ids").toArrow()
    # stays in Arrow buffers: the driver holds some ten bytes a word, each worker makes its own dictionary
    words, lists = (got.column(c).combine_chunks().flatten() if got.num_rows else pa.array([], t) for c, t in ((0, pa.string()), (1, pa.list_(pa.int32()))))
    ends = (lists.offsets.to_numpy() - lists.offsets[0].as_py()).astype(np.int32) * 4
    bits = lists.flatten().to_numpy().astype(np.int32).tobytes()
    ids = pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(ends), pa.py_buffer(bits)])
    sink = pa.BufferOutputStream()
    table = pa.table({"word": words, "ids": ids})
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def dictionary(data: bytes) -> dict[str, bytes]:
    """The words of ``frequent_words`` as a dictionary.

    Made anew for each task: Python workers take either step of the next one, and each would keep its own.
    """
    words: dict[str, bytes] = {}
    for b in pa.ipc.open_stream(data):
        for lo in range(0, b.num_rows, 20_000):
            part = b.slice(lo, 20_000)
            words.update(zip(part.column("word").to_pylist(), part.column("ids").to_pylist()))
    return words


def encoded(docs: DataFrame, path: str | None = None, pattern: str | None = None, sample_docs: int = SAMPLE_DOCS, cached_words: int = CACHED_WORDS) -> DataFrame:
    """Per row: doc_id, n_tokens, ids (decimal, joined by spaces), decoded (binary)."""
    spark = docs.sparkSession
    pattern = pattern or default_pattern()
    tokens = load_ranks(path)
    ranks = RankMap(spark, tokens)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = spark.sparkContext.broadcast(frequent_words(docs, ranks, pattern, sample_docs, cached_words))
    vocabulary = spark.sparkContext.broadcast(sorted(tokens, key=tokens.get))
    single = np.array([tokens[bytes([b])] for b in range(256)], np.int64)
    merges = spark.sparkContext.broadcast((PairRanks(ranks.pairs), single))

    def block(batches: Iterator[pa.RecordBatch]):
        chunks = Chunks(dictionary(known.value), pattern)
        ids, out, chars, b = [], [], 0, None

        def block_row():
            words = [w.encode() for w in chunks.end_block()]
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((ids, out, words), kinds)], ["doc_ids", "packed", "words"])

        for b in batches:
            for lo in range(0, b.num_rows, 200):  # few texts at a time as Python strings
                part = b.slice(lo, 200)
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    if out and chars + len(text) > BLOCK_CHARS:
                        yield block_row()
                        ids, out, chars = [], [], 0
                    ids.append(doc_id)
                    out.append(chunks.text(text))
                    chars += len(text)
        if out:
            yield block_row()
        del b, chunks  # what a task held goes back before the worker waits for the next one
        pa.default_memory_pool().release_unused()

    def finish(batches: Iterator[pa.RecordBatch]):
        pieces, (pairs, single) = vocabulary.value, merges.value
        names = [str(i) for i in range(len(pieces))]
        by_bytes: dict[bytes, int] = {}
        for b in batches:
            for row in range(b.num_rows):
                doc_ids, packed, words = (b.column(c)[row].as_py() for c in ("doc_ids", "packed", "words"))
                folded = merge_words([w if len(w) <= FOLD_BYTES else b"" for w in words], pairs, single, single)
                for i, w in enumerate(words):
                    if len(w) > FOLD_BYTES:
                        by_bytes = by_bytes or {t: i for i, t in enumerate(pieces)}
                        folded[i] = np.asarray(heap_encode(w, by_bytes), np.int32).tobytes()
                sizes, joined, decoded = [], [], []
                for p in packed:  # the ids of one document at a time as Python numbers
                    full = fill(p, folded)
                    sizes.append(len(full))
                    joined.append(" ".join(map(names.__getitem__, full)))
                    decoded.append(b"".join(map(pieces.__getitem__, full)))
                cols = [pa.array(doc_ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(joined, pa.string()), pa.array(decoded, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids", "decoded"])
        pa.default_memory_pool().release_unused()

    kinds = pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.binary())
    blocks = docs.mapInArrow(block, "doc_ids array<bigint>, packed array<binary>, words array<binary>")
    return blocks.mapInArrow(finish, "doc_id bigint, n_tokens bigint, ids string, decoded binary")


def encode_digests(docs: DataFrame, **options) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    e = encoded(docs, **options)
    return e.select("doc_id", "n_tokens", F.sha2(F.col("ids").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

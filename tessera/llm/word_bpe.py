"""BPE with word ends: a minimal acyclic transducer for frequent words, exact merges for the rest.

All documents are cut into words by the tokenizer's normaliser and pattern and the
words are counted; the ``LEXICON_WORDS`` most frequent ones are merged once, in
Spark tasks, and compiled into a transducer: a minimal acyclic automaton over the
bytes of the words (words in order, equal tails of the automaton registered and
shared), whose arcs carry numbers that add up along a word to its place in a table
of ids. Arcs lie in one array sorted by (state, byte). The file goes to the shared
checkpoint folder, Spark hands it to each executor once (``addFile``), and all of
its Python workers map the same pages into memory.

A task reads blocks of documents of bounded size, cut at spaces into chunks (no word and no
composition reaches over a space). The distinct words of a block's new chunks walk
through the arcs together, one byte a step, as numpy arrays; words that the automaton
does not accept are merged exactly by a heap of ranked pairs, leftmost of equal ranks
first. Which words are in the lexicon therefore changes the work, never a result.
Decoding joins the tokens of the ids by spaces, as the library does for a tokenizer
without a decoder.

Words are cut like the library's: added tokens are taken out of the raw text first (the
strings of special tokens become their ids); each stretch between them is normalised to
NFC and lower-cased letter by letter, and the pattern's matches are the words. Classes of
letters and cases are those of the library's Unicode version (``unicode_tables``).

Defined results: a null text counts as empty; a text without a match has 0 tokens and
the digests of the empty string; rows are handled one by one, so null or repeated
doc_ids and ties do no harm; a word of any length is merged whole; an empty table
gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import re
import struct
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.pair_merge import NONE, PLACE, PairRanks, merge_words
from tessera.session import ensure_checkpoint_dir

#: Words in the transducer: a bound on what the driver holds and on the mapped file.
LEXICON_WORDS = 400_000
#: Longer words (bytes) are never put into it.
LEXICON_WORD_BYTES = 64
#: Characters of text that a task cuts at once; distinct chunks that it counts before sending them on, and that it remembers.
BLOCK_CHARS = 6 << 20
COUNTED = 250_000
MEMO = 300_000
#: Words outside the lexicon that a task remembers besides.
MERGED = 150_000


#: The pattern of the default file, whose words of ASCII letters are runs of them, and marks that are words by themselves.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
MARKS = frozenset(".,;:!?")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Vocabulary:
    """The tokenizer's file: ids, ranked pairs, pattern and added tokens."""

    def __init__(self, path: str | None = None):
        with open(path or default_path(), encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end, ids = model["end_of_word_suffix"], model["vocab"]
        self.tokens = {i: t for t, i in ids.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.pairs = {(ids[a] << 32) | ids[b]: (rank << 32) | ids[a + b] for rank, (a, b) in enumerate(model["merges"])}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tables = unicode_tables()
        if any(" " in t for t in self.added):
            raise ValueError("an added token holds a space; texts are cut at spaces first")
        self.pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        letters = byte_letters()
        self.inner, self.last = [ids[c] for c in letters], [ids[c + self.end] for c in letters]


def byte_letters() -> list[str]:
    """The printable letter of each byte: itself where it is printable in Latin-1, else the next free one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(0x100 + rest.index(b)) for b in range(256)]


def ranges(points) -> str:
    """Code points as ranges of a character class."""
    runs: list[list[int]] = []
    for c in sorted(points):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\U{lo:08x}-\\U{hi:08x}" for lo, hi in runs)


def unicode_tables() -> dict[str, str]:
    """Classes as ranges, asked from the library, whose Unicode version is not Python's: letters,
    numbers, white space, and ``odd``: what it lower-cases or reorders in another way than Python."""
    from tokenizers import Regex, normalizers, pre_tokenizers

    every = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    lines = ["".join(map(chr, every[i : i + 4096])) for i in range(0, len(every), 4096)]
    out = {}
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        find = pre_tokenizers.Split(Regex(name), "removed", invert=True)
        out[name] = ranges({ord(c) for line in lines for t, _ in find.pre_tokenize_str(line) for c in t})
    lower, nfc = normalizers.Lowercase().normalize_str, normalizers.NFC().normalize_str
    odd = {ord(c) for line in lines if lower(line) != line.replace("Σ", "σ").lower() for c in line if lower(c) != c.replace("Σ", "σ").lower()}
    for c in map(chr, every):
        parts = unicodedata.normalize("NFD", c)
        if len(parts) > 1 and nfc(parts) != unicodedata.normalize("NFC", parts):
            odd |= set(map(ord, parts + c))
        if unicodedata.combining(c) and any(nfc(x) != unicodedata.normalize("NFC", x) for x in ("a" + c + "\u0323", "\u00e1" + c)):
            odd.add(ord(c))
    return out | {"odd": ranges(odd)}


class Cutter:
    """Text -> its words; the string of an added token stands for it (no other word holds both letters and marks)."""

    def __init__(self, pattern: str, added: list[str], tables: dict[str, str]):
        def compiled(keep) -> re.Pattern:
            p = pattern
            for name in (r"\p{L}", r"\p{N}", r"\s"):
                kept = (r for r in re.findall(r"\\U(.{8})-\\U(.{8})", tables[name]) if keep(int(r[0], 16)))
                p = p.replace(name, "".join(rf"\U{lo}-\U{hi}" for lo, hi in kept))
            return re.compile(p)

        self.simple = pattern == PATTERN
        # the further the letters of a text reach, the more ranges its words have to be compared with
        self.ascii, self.wide, self.full = (compiled(f).findall for f in (lambda c: c < 0x80, lambda c: c < 0x10000, lambda c: True))
        self.above, self.odd = re.compile("[\U00010000-\U0010ffff]").search, re.compile(f"[{tables['odd']}]").search
        self.added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    def words(self, text: str) -> list[str]:
        if self.simple and text.isascii():  # letters alone, or before one mark, need no search
            if text.isalpha():
                return [text.lower()]
            if text[-1:] in MARKS and text[:-1].isalpha():
                return [text[:-1].lower(), text[-1]]
        if self.added is None or not self.added.search(text):
            return self.plain(text)
        parts = self.added.split(text)
        return list(chain.from_iterable([p] if i % 2 else self.plain(p) for i, p in enumerate(parts)))

    def plain(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii(text.lower())
        if self.odd(text):
            from tokenizers import normalizers

            text = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str(text)
        else:
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # a final sigma is not treated apart
        return (self.full if self.above(text) else self.wide)(text)


RANK = ~PLACE


class Merger:
    """Ids of a word (UTF-8 bytes) by its ranked merges."""

    def __init__(self, v: Vocabulary):
        self.pair, self.inner, self.last = v.pairs.get, v.inner, v.last
        self.table, self.letters = PairRanks(v.pairs), np.array([v.inner, v.last], np.int64)

    def many(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of each word; short words are merged together."""
        out = merge_words([w if len(w) <= LEXICON_WORD_BYTES else b"" for w in words], self.table, *self.letters)
        for k, w in enumerate(words):
            if len(w) > LEXICON_WORD_BYTES:
                out[k] = np.array(self.ids(w), "<i4").tobytes()
        return out

    def ids(self, word: bytes) -> list[int]:
        """Looking through all pairs for the least rank is quick in a short word; a long one keeps them in a heap."""
        ids = [self.inner[b] for b in word]
        ids[-1] = self.last[word[-1]]
        return self.scanned(ids) if len(word) <= LEXICON_WORD_BYTES else self.heaped(ids)

    def scanned(self, ids: list[int]) -> list[int]:
        pair = self.pair
        ranks = [pair(a << 32 | b, NONE) for a, b in zip(ids, ids[1:])]
        while ranks and (low := min(ranks)) != NONE:
            i, new = ranks.index(low), low & PLACE
            ids[i : i + 2] = [new]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = pair(new << 32 | ids[i + 1], NONE)
            if i:
                ranks[i - 1] = pair(ids[i - 1] << 32 | new, NONE)
        return ids

    def heaped(self, ids: list[int]) -> list[int]:
        n, pair = len(ids), self.pair
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # rank and place in one number; a rank names its pair, so a look at the two ids tells whether an entry still holds
        heap = [got & RANK | i for i, two in enumerate(zip(ids, ids[1:])) if (got := pair(two[0] << 32 | two[1])) is not None]
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            i = top & PLACE
            j = after[i]
            if j >= n or ids[i] < 0 or (got := pair(ids[i] << 32 | ids[j])) is None or (got ^ top) & RANK:
                continue  # one of the two has been merged meanwhile
            ids[i], ids[j] = new, _ = got & PLACE, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (got := pair(new << 32 | ids[k])) is not None:
                    heapq.heappush(heap, got & RANK | i)
            if (h := before[i]) >= 0 and (got := pair(ids[h] << 32 | new)) is not None:
                heapq.heappush(heap, got & RANK | h)
        return [x for x in ids if x >= 0]


# --- the transducer -----------------------------------------------------------


def compile_words(words: list[bytes], ids: list[bytes]) -> bytes:
    """The file of the minimal acyclic transducer of distinct ``words``; ``ids``: of each word, as packed 32-bit integers.

    Words are added in order. What the next word does not share with the last one is
    final: its states are looked up in a register from the tail upwards and replaced by
    an equal state if there is one. A state counts the words below it, so that an arc's
    number (the words that leave its state before it) adds up to the word's place.
    """
    order = sorted(range(len(words)), key=words.__getitem__)
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...], int]] = []  # final, arcs, words below

    def settle(final: bool, arcs: list[tuple[int, int]]) -> int:
        key = (final, tuple(arcs))
        if key not in register:
            register[key] = len(states)
            states.append((*key, final + sum(states[to][2] for _, to in arcs)))
        return register[key]

    path: list[list] = [[False, []]]  # of the last word: final, settled arcs of each state
    last = b""
    for k in order:
        word = words[k]
        same = next((i for i, (a, b) in enumerate(zip(word, last)) if a != b), min(len(word), len(last)))
        for i in range(len(last), same, -1):
            final, arcs = path.pop()
            path[-1][1].append((last[i - 1], settle(final, arcs)))
        path.extend([False, []] for _ in range(same, len(word)))
        path[-1][0], last = True, word
    for i in range(len(last), 0, -1):
        final, arcs = path.pop()
        path[-1][1].append((last[i - 1], settle(final, arcs)))
    start = settle(*path[0])

    keys, to, add = [], [], []
    for s, (final, arcs, _) in enumerate(states):
        number = int(final)
        for byte, child in arcs:
            keys.append((s << 8) | byte)
            to.append(child)
            add.append(number)
            number += states[child][2]
    ends = np.cumsum([0] + [len(ids[k]) // 4 for k in order])
    arrays = [
        np.array(keys, np.int64), np.array(to, np.int32), np.array(add, np.int32), np.array([s[0] for s in states], np.uint8),
        ends.astype(np.int64), np.frombuffer(b"".join(ids[k] for k in order), np.int32),
    ]
    head = json.dumps({"start": start, "arrays": [[a.dtype.str, len(a)] for a in arrays]}).encode()
    parts = [struct.pack("<q", len(head)), head]
    for a in arrays:
        parts += bytes(-sum(map(len, parts)) % 8), a.tobytes()
    return b"".join(parts)


class Lexicon:
    """A compiled transducer, read in place from a mapped file."""

    def __init__(self, data):
        (n,) = struct.unpack_from("<q", data)
        spec, at, arrays = json.loads(bytes(data[8 : 8 + n])), 8 + n, []
        for kind, length in spec["arrays"]:
            at += -at % 8
            arrays.append(np.frombuffer(data, kind, length, at))
            at += arrays[-1].nbytes
        self.start = spec["start"]
        self.keys, self.to, self.add, self.final, self.ends, self.ids = arrays

    def find(self, words: list[bytes]) -> list[bytes | None]:
        """Packed ids of each word, None for those not in the lexicon."""
        if not words or not len(self.keys):
            return [None] * len(words)
        letters = np.frombuffer(b"".join(words), np.uint8)
        size = np.fromiter(map(len, words), np.int64, len(words))
        begin = np.cumsum(size) - size
        state, number = np.full(len(words), self.start, np.int64), np.zeros(len(words), np.int64)
        live, step = np.flatnonzero(size <= LEXICON_WORD_BYTES), 0
        lost = np.ones(len(words), bool)
        lost[live] = False
        while len(live := live[size[live] > step]):
            key = (state[live] << 8) | letters[begin[live] + step]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[arc] == key
            lost[live[~hit]] = True
            live, arc = live[hit], arc[hit]
            state[live] = self.to[arc]
            number[live] += self.add[arc]
            step += 1
        lost |= self.final[state] == 0
        number[lost] = 0
        lo, hi = self.ends[number].tolist(), self.ends[number + 1].tolist()
        return [None if x else self.ids[a:b].tobytes() for x, a, b in zip(lost.tolist(), lo, hi)]


_MAPPED: dict[str, Lexicon] = {}


def mapped(name: str) -> Lexicon:
    """The lexicon of this executor's copy of the file; workers share its pages."""
    if name not in _MAPPED:
        with open(SparkFiles.get(name), "rb") as f:
            _MAPPED.clear()
            _MAPPED[name] = Lexicon(memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)))
    return _MAPPED[name]


def share(spark: SparkSession, data: bytes) -> str:
    """Put the file into the shared checkpoint folder and hand it to the executors; its name for ``mapped``."""
    name = f"lexicon-{hashlib.sha256(data).hexdigest()[:24]}.bin"
    sc = spark.sparkContext
    ensure_checkpoint_dir(spark)
    path = sc._jvm.org.apache.hadoop.fs.Path(sc.getCheckpointDir(), name)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(path):
        out = fs.create(path)
        out.write(bytearray(data))
        out.close()
    if not any(f.endswith("/" + name) for f in sc.listFiles):
        sc.addFile(str(path))
    return name


# --- Spark ----------------------------------------------------------------------


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def word_counts(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """(word, n) over all documents; words too long for the lexicon are left out."""
    pattern, added, tables = v.pattern, list(v.added), v.tables

    def run(batches: Iterator[pa.RecordBatch]):
        cut, seen = Cutter(pattern, added, tables), Counter()

        def batch():
            words: Counter = Counter()
            for chunk, n in seen.items():
                for w in cut.words(chunk):
                    words[w] += n
            kept = [w for w in words if len(w) <= LEXICON_WORD_BYTES and w not in added]
            return pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), pa.array([words[w] for w in kept], pa.int64())], ["word", "n"])

        for b in batches:
            texts = b.column("text")
            for i in range(b.num_rows):
                seen.update(texts[i].as_py().split(" "))
                if len(seen) >= COUNTED:
                    yield batch()
                    seen.clear()
        yield batch()

    return _texts(docs).select("text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def lexicon(docs: DataFrame, v: Vocabulary, n_words: int) -> bytes:
    """The transducer of the most frequent words; at most ``n_words`` short rows reach the driver."""
    top = word_counts(docs, v).where(F.octet_length("word") <= LEXICON_WORD_BYTES).orderBy(F.col("n").desc(), "word").limit(n_words).select("word")
    shared = docs.sparkSession.sparkContext.broadcast(v)

    def run(batches: Iterator[pa.RecordBatch]):
        merge = Merger(shared.value)
        for b in batches:
            words = b.column("word").cast(pa.binary())
            ids = merge.many(words.to_pylist())
            yield pa.RecordBatch.from_arrays([words, pa.array(ids, pa.binary())], ["word", "ids"])

    spread = top.repartition(docs.sparkSession.sparkContext.defaultParallelism, "word")
    got = spread.mapInArrow(run, "word binary, ids binary").toArrow()
    return compile_words(got.column("word").to_pylist(), got.column("ids").to_pylist())


class Memo:
    """Chunks (what stands between two spaces) -> packed ids, and decoded bytes with a space before each token."""

    def __init__(self, v: Vocabulary, lex: Lexicon):
        self.lex, self.merge, self.cut, self.added = lex, Merger(v), Cutter(v.pattern, list(v.added), v.tables), v.added
        self.names = [b" " + v.tokens.get(i, "").encode() for i in range(max(v.tokens) + 1)]
        self.merged: dict[str, bytes] = {}
        self.ids: dict[str, bytes] = {}
        self.text: dict[str, bytes] = {}

    def learn(self, chunks: set[str]):
        """Know all ``chunks``; when there are too many, those of former blocks that are not among them go."""
        new = [c for c in chunks if c not in self.ids]
        if len(self.ids) + len(new) > MEMO:
            kept = [c for c in chunks if c in self.ids]
            self.ids, self.text = {c: self.ids[c] for c in kept}, {c: self.text[c] for c in kept}
        cut = list(map(self.cut.words, new))
        words = list(set(chain.from_iterable(cut)) - self.added.keys())
        raw = [w.encode() for w in words]
        if len(self.merged) > MERGED:
            self.merged.clear()
        known = dict(zip(words, self.lex.find(raw)))
        known.update(self.exact([(w, r) for w, r in zip(words, raw) if known[w] is None]))
        known.update((t, struct.pack("<i", i)) for t, i in self.added.items())
        name = self.names
        for c, w in zip(new, cut):
            self.ids[c] = ids = known[w[0]] if len(w) == 1 else b"".join(map(known.__getitem__, w))
            self.text[c] = b"".join(map(name.__getitem__, memoryview(ids).cast("i")))

    def exact(self, words: list[tuple[str, bytes]]) -> dict[str, bytes]:
        """Packed ids of words outside the lexicon."""
        new = [x for x in words if x[0] not in self.merged]
        self.merged.update(zip([w for w, _ in new], self.merge.many([r for _, r in new])))
        return {w: self.merged[w] for w, _ in words}


_MEMOS: dict[str, Memo] = {}


def _memo(call: str, v: Vocabulary, name: str) -> Memo:
    """The memo of one call, kept by a worker from task to task."""
    if call not in _MEMOS:
        _MEMOS.clear()
        _MEMOS[call] = Memo(v, mapped(name))
    return _MEMOS[call]


def encoded(docs: DataFrame, path: str | None = None, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """Per row: doc_id, n_tokens, ids (little-endian unsigned 32-bit integers), decoded (UTF-8)."""
    v = Vocabulary(path)
    docs = _texts(docs)
    name = share(docs.sparkSession, lexicon(docs, v, lexicon_words))
    shared, call = docs.sparkSession.sparkContext.broadcast(v), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]):
        memo = _memo(call, shared.value, name)
        rows: list[tuple[int | None, list[str]]] = []
        size = 0

        def block():
            memo.learn(set().union(*(chunks for _, chunks in rows)))
            ids = [b"".join(map(memo.ids.__getitem__, chunks)) for _, chunks in rows]
            text = [b"".join(map(memo.text.__getitem__, chunks))[1:] for _, chunks in rows]
            cols = [pa.array([d for d, _ in rows], pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(text, pa.binary())]
            return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids", "decoded"])

        for b in batches:
            doc_ids, texts = b.column("doc_id"), b.column("text")
            for i in range(b.num_rows):
                text = texts[i].as_py()
                rows.append((doc_ids[i].as_py(), text.split(" ")))
                size += len(text)
                if size >= BLOCK_CHARS:
                    yield block()
                    rows, size = [], 0
        if rows:
            yield block()

    return docs.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary, decoded binary")


def encode_digests(docs: DataFrame, **options) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    e = encoded(docs, **options)
    return e.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

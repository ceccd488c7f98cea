"""Removal of repeated passages with a logarithmic family of suffix arrays.

Every byte covered by a string of ``LENGTH`` bytes that starts at least twice in the
corpus goes. Matches never cross documents and are judged on the input.

Suffixes are sampled by content: of the ``GRAM``-byte strings inside each window of
``LENGTH`` bytes the one of least fingerprint is the window's anchor, so equal
windows have equal anchors wherever they stand, and about one suffix in ninety
is kept. A run is a maximal stretch of window starts with one anchor; its class is the
fingerprint of the text all its windows cover. Two windows can be equal only if
their anchors are.

A batch of documents becomes an array of its sampled suffixes, sorted by the
fingerprint of what they begin with (only equality of long prefixes matters,
not their order by letter): a bucketed, sorted table. It is merge-scanned
against the levels that stand, bucket by bucket without a shuffle, which gives the
anchors met before; then it becomes a level of its own, and two levels of equal
size are merged into one of twice the size, so there are never more levels than
the logarithm of the number of batches.

Anchors met more than once are settled exactly. If all their runs are of one
class, every window repeats. Otherwise the windows of one run per class are
sorted by their own fingerprints and equal neighbours found; an anchor with more
than ``CROWD`` classes (the edge of a very common passage) is settled by counting
its windows one by one, spread over all tasks, the same decision by another route.

Fingerprints have 64 bits over random byte weights; a window is told equal by
its anchor's and its own together.

Defined results: a null or short text keeps all its bytes; a null doc_id is a key
like any other; rows that repeat doc_id and text are documents of their own and so
repeat each other; an empty table gives an empty result. Removed bytes may leave
incomplete UTF-8 sequences, as the rule is about bytes. Only doc_id and text are
read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut_lineage

LENGTH = 200
GRAM = 32
BATCHES = 4
CROWD = 4096
#: Bytes whose fingerprints a task holds at once (some twenty arrays of 8 bytes each), and texts it holds as Python objects.
SLICE_BYTES = 1 << 18
SLICE_TEXTS = 1000
_MUL = 0x9E3779B97F4A7C15
_WEIGHTS = np.random.default_rng(12).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def run(x):
        return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, x, np.uint64))))

    with np.errstate(over="ignore"):
        return run(_MUL), run(pow(_MUL, -1, 1 << 64))


class Prints:
    """Fingerprints of all stretches of a byte array."""

    _tables: tuple | None = None

    def __init__(self, b: np.ndarray):
        if Prints._tables is None or len(Prints._tables[0]) <= len(b):
            Prints._tables = _powers(max(len(b) + 1, SLICE_BYTES + LENGTH + 1))
        up, self.down = Prints._tables
        self.sums = np.zeros(len(b) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_WEIGHTS[b] * up[: len(b)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        step = np.uint64(0xD6E8FEB86659FD93)
        with np.errstate(over="ignore"):
            h = (self.sums[end] - self.sums[start]) * self.down[start]
            h = (h ^ (h >> np.uint64(32))) * step
            h = (h ^ (h >> np.uint64(29))) * step
        return h ^ (h >> np.uint64(32))


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of ``width``."""
    m, s = v, 1
    while s * 2 <= width:
        m = np.minimum(m[: len(m) - s], m[s:])
        s *= 2
    n = len(v) - width + 1
    return np.minimum(m[:n], m[width - s : width - s + n])


def _again(grams: np.ndarray, least: np.ndarray, lo: np.ndarray, hi: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether a run's anchor stands at more than one place in it."""
    width = LENGTH - GRAM + 1
    # a place is an anchor if it equals the greatest minimum of the windows that hold it
    padded = np.concatenate((np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)))
    at = np.flatnonzero(grams == ~_least(~padded, width))
    values, rank = np.unique(grams[at], return_inverse=True)
    order = np.sort(rank.astype(np.int64) << 32 | at)
    own = np.searchsorted(values, key).astype(np.int64) << 32
    second = np.searchsorted(order, own | lo) + 1
    ok = second < len(order)
    nxt = order[np.where(ok, second, 0)]
    return ok & (nxt >> 32 == own >> 32) & ((nxt & 0xFFFFFFFF) <= hi + LENGTH - GRAM)


def slices(texts: list[bytes]) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int, int]]]]:
    """Texts joined to arrays of bounded size, with (text, offset in text, from, to) of each piece.

    Pieces of one long text overlap by LENGTH - 1, so each window is in one piece.
    """
    held, pieces, size = [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - LENGTH + 1), SLICE_BYTES):
            part = t[at : at + SLICE_BYTES + LENGTH - 1]
            if size and size + len(part) > SLICE_BYTES:
                yield np.frombuffer(b"".join(held), np.uint8), pieces
                held, pieces, size = [], [], 0
            held.append(part)
            pieces.append((i, at, size, size + len(part)))
            size += len(part)
    if held:
        yield np.frombuffer(b"".join(held), np.uint8), pieces


def runs(texts: list[bytes]) -> dict[str, np.ndarray]:
    """All runs: text, lo, hi (first and last window start in the text), key, cls, own (windows may repeat inside)."""
    out: dict[str, list] = {k: [] for k in ("text", "lo", "hi", "key", "cls", "own")}
    for b, pieces in slices(texts):
        if len(b) < LENGTH:
            continue
        p = Prints(b)
        grams = p.of(np.arange(len(b) - GRAM + 1), np.arange(GRAM, len(b) + 1))
        least = _least(grams, LENGTH - GRAM + 1)
        piece = np.array(pieces)
        begin, end = piece[:, 2], piece[:, 3] - LENGTH + 1  # window starts of each piece
        first = np.zeros(len(least) + 1, np.int64)
        some = begin < end
        np.add.at(first, begin[some], 1)
        np.add.at(first, end[some], -1)
        inside = np.cumsum(first[:-1]) > 0
        starts = np.zeros(len(least), bool)
        starts[begin[some]] = True
        starts[1:] |= (least[1:] != least[:-1]) | ~inside[:-1]
        lo = np.flatnonzero(starts & inside)
        if not len(lo):
            continue
        owner = np.searchsorted(begin, lo, "right") - 1
        owner = np.maximum.accumulate(np.where(some[owner], owner, 0))
        hi = np.minimum(np.concatenate((lo[1:], [len(least)])), end[owner]) - 1
        key = least[lo]
        many = _again(grams, least, lo, hi, key)
        out["text"].append(piece[owner, 0])
        shift = piece[owner, 1] - piece[owner, 2]
        out["lo"].append(lo + shift)
        out["hi"].append(hi + shift)
        out["key"].append(key)
        out["cls"].append(p.of(lo, hi + LENGTH))
        out["own"].append(many)
    kinds = {"text": np.int64, "lo": np.int64, "hi": np.int64, "key": np.uint64, "cls": np.uint64, "own": bool}
    return {k: np.concatenate(v) if v else np.zeros(0, kinds[k]) for k, v in out.items()}


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches in parts of a few texts; buffers go back before the worker waits for its next task."""
    for b in batches:
        for lo in range(0, b.num_rows, SLICE_TEXTS):
            yield b.slice(lo, SLICE_TEXTS)
        del b
    pa.default_memory_pool().release_unused()


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sampled suffixes of documents, one row per anchor and part of an Arrow batch."""
    for b in _parts(batches):
        r = runs([t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()])
        order = np.argsort(r["key"], kind="stable")
        key, cls, own = r["key"][order], r["cls"][order].view(np.int64), r["own"][order]
        if not len(key):
            continue
        at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        n = np.diff(np.concatenate((at, [len(key)])))
        cols = [_signed(key[at]), pa.array(n), pa.array(np.minimum.reduceat(cls, at)), pa.array(np.maximum.reduceat(cls, at)), pa.array(np.logical_or.reduceat(own, at))]
        yield pa.RecordBatch.from_arrays(cols, ["key", "n", "c0", "c1", "own"])


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _parts(batches):
        r = runs([t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()])
        at = pa.array(r["text"])
        cols = [b.column("doc_id").take(at), b.column("th").take(at), pa.array(r["lo"]), pa.array(r["hi"]), _signed(r["key"]), _signed(r["cls"])]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "th", "lo", "hi", "key", "cls"])


class Family:
    """Levels of sampled suffix arrays: bucketed, sorted tables (key, n, c0, c1, own).

    n: runs of the anchor; c0 and c1: least and greatest class; own: see ``runs``.
    """

    def __init__(self, spark, buckets: int):
        self.spark, self.buckets, self.levels, self.met, self.made = spark, buckets, [], [], []

    def _write(self, df: DataFrame) -> str:
        name = f"suffix_level_{uuid.uuid4().hex}"
        df.write.bucketBy(self.buckets, "key").sortBy("key").saveAsTable(name)
        self.made.append(name)
        return name

    def add(self, rows: DataFrame) -> None:
        """Index one batch: scan it against all levels, then let equal levels merge."""
        level = self._write(_per_key(rows))
        new = self.spark.table(level)
        self.met.append(cut_lineage(new.where("n > 1 OR own").select("key")))
        for _, old in self.levels:
            self.met.append(cut_lineage(new.select("key").join(self.spark.table(old).select("key"), "key")))
        size = 1
        while self.levels and self.levels[-1][0] == size:
            _, old = self.levels.pop()
            merged = self._write(self._merged(self.spark.table(old), self.spark.table(level)))
            for gone in (old, level):
                self._drop(gone)
            level, size = merged, size * 2
        self.levels.append((size, level))

    @staticmethod
    def _merged(a: DataFrame, b: DataFrame) -> DataFrame:
        """Merge by the sorted key; both sides are bucketed alike, so nothing is shuffled."""
        j = a.alias("a").join(b.alias("b"), F.col("a.key") == F.col("b.key"), "full_outer")
        n = F.coalesce("a.n", F.lit(0)) + F.coalesce("b.n", F.lit(0))
        own = F.coalesce("a.own", F.lit(False)) | F.coalesce("b.own", F.lit(False))
        return j.select(F.coalesce("a.key", "b.key").alias("key"), n.alias("n"), F.least("a.c0", "b.c0").alias("c0"), F.greatest("a.c1", "b.c1").alias("c1"), own.alias("own"))

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.made.remove(name)

    def repeated(self) -> DataFrame:
        """key, crowd-independent facts of every anchor met more than once: key, several."""
        keys = self.met[0]
        for m in self.met[1:]:
            keys = keys.union(m)
        keys = keys.distinct()
        found = None
        for _, name in self.levels:
            part = self.spark.table(name).join(keys, "key", "left_semi")
            found = part if found is None else found.union(part)
        return cut_lineage(_per_key(found).select("key", ((F.col("c0") != F.col("c1")) | F.col("own")).alias("several")))

    def close(self) -> None:
        for name in list(self.made):
            self._drop(name)


def _per_key(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.sum("n").alias("n"), F.min("c0").alias("c0"), F.max("c1").alias("c1"), F.max("own").alias("own"))


def _windows(keys: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(row, print) of every window of the runs' texts; equal windows under one key have equal prints."""
    sizes = np.array([len(t) for t in texts])
    n = sizes - LENGTH + 1
    row = np.repeat(np.arange(len(texts)), n)
    p = Prints(np.frombuffer(b"".join(texts), np.uint8))
    base = np.cumsum(sizes) - sizes
    at = base[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    with np.errstate(over="ignore"):
        return row, p.of(at, at + LENGTH) ^ (keys.view(np.uint64)[row] * np.uint64(_MUL))


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key (key, n, doc_id, th, lo, run): spans of repeated windows of rows with n = 1."""

    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        keys, texts = t.column("key").to_numpy(), t.column("run").to_pylist()
        row, prints = _windows(keys, texts)
        order = np.argsort(prints, kind="stable")
        same = prints[order][1:] == prints[order][:-1]
        again = np.zeros(len(row), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        again &= (t.column("n").to_numpy() == 1)[row]
        hit = np.flatnonzero(again)
        if not len(hit):
            return
        new = np.concatenate(([True], (np.diff(hit) > 1) | (row[hit][1:] != row[hit][:-1])))
        a, b = hit[new], hit[np.concatenate((new[1:], [True]))]
        n = np.array([len(x) for x in texts]) - LENGTH + 1
        first = (np.cumsum(n) - n)[row[a]]
        lo = t.column("lo").to_numpy()[row[a]]
        at = pa.array(row[a])
        cols = [t.column("doc_id").combine_chunks().take(at), t.column("th").combine_chunks().take(at), pa.array(lo + a - first), pa.array(lo + b - first + LENGTH)]
        yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols], ["doc_id", "th", "lo", "hi"])

    held: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        held = t if held is None else pa.concat_tables([held, t])
        if held.num_rows < 4000:
            continue
        k = held.column("key").to_numpy()
        cut = int(np.argmax(k == k[-1]))  # the last key may go on
        if cut:
            yield from work(held.slice(0, cut).combine_chunks())
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield from work(held.combine_chunks())


def _one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of the runs of crowded anchors as a row."""
    for b in batches:
        for lo in range(0, b.num_rows, 2000):
            t = b.slice(lo, 2000)
            row, prints = _windows(t.column("key").to_numpy(), t.column("run").to_pylist())
            at = pa.array(row)
            n = np.bincount(row, minlength=t.num_rows)
            place = t.column("lo").to_numpy()[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            cols = [t.column(c).take(at) for c in ("key", "n", "doc_id", "th")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(place), _signed(prints)], ["key", "n", "doc_id", "th", "lo", "print"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of each listed run of a document."""
    for b in _parts(batches):
        for i, t in enumerate(b.column("text").cast(pa.binary()).to_pylist()):
            found = b.column("reps")[i].as_py()
            rows = [{"key": r["key"], "n": r["n"], "crowd": r["crowd"], "lo": r["lo"], "run": t[r["lo"] : r["hi"] + LENGTH]} for r in found]
            if rows:
                part = pa.RecordBatch.from_pylist(rows, pa.schema([("key", pa.int64()), ("n", pa.int64()), ("crowd", pa.bool_()), ("lo", pa.int64()), ("run", pa.binary())]))
                one = pa.array([i] * len(rows))
                yield pa.RecordBatch.from_arrays([*part.columns, b.column("doc_id").take(one), b.column("th").take(one)], [*part.schema.names, "doc_id", "th"])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _parts(batches):
        out = []
        for i, t in enumerate(b.column("text").cast(pa.binary()).to_pylist()):
            t, spans, at, kept = t or b"", b.column("spans")[i].as_py() or [], 0, []
            merged: list[list[int]] = []
            for s in sorted((x["lo"], x["hi"]) for x in spans):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append(list(s))
            for lo, hi in merged:
                kept.append(t[at:lo])
                at = hi
            kept.append(t[at:])
            out.append((len(t), sum(h - a for a, h in merged), merged, b"".join(kept)))
        cols = [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.list_(pa.list_(pa.int64()))), pa.array([x[3] for x in out], pa.binary())]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], ["doc_id", "n_bytes", "n_removed", "spans", "kept"])


def _prepared(docs: DataFrame) -> DataFrame:
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return d.withColumn("th", F.xxhash64("text"))


def _beside(docs: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """``docs`` with the lists of their rows."""
    right = lists.withColumnRenamed("doc_id", "_d").withColumnRenamed("th", "_t")
    return docs.join(right, docs["doc_id"].eqNullSafe(right["_d"]) & (docs["th"] == right["_t"]), how).drop("_d", "_t")


def repeated_spans(docs: DataFrame, batches: int = BATCHES, crowd: int = CROWD) -> DataFrame:
    """doc_id, th (hash of the text), lo, hi: stretches of repeated bytes, as offsets; they may overlap."""
    spark = docs.sparkSession
    d = _prepared(docs)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    family = Family(spark, buckets)
    try:
        for i in range(batches):
            batch = d.where(F.pmod(F.xxhash64("doc_id", "th"), F.lit(batches)) == i).select("text")
            family.add(batch.mapInArrow(_entries, "key bigint, n bigint, c0 bigint, c1 bigint, own boolean"))
        known = family.repeated()
    finally:
        family.close()
    occ = d.mapInArrow(_occurrences, "doc_id bigint, th bigint, lo bigint, hi bigint, key bigint, cls bigint")
    met = cut_lineage(occ.join(known, "key"))
    span = ["doc_id", "th", "lo", (F.col("hi") + LENGTH).alias("hi")]
    several = met.where("several")
    classes = several.groupBy("key", "cls").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "th", "lo", "hi")).alias("rep"))
    classes = cut_lineage(classes)
    crowds = classes.groupBy("key").count().where(F.col("count") > crowd).select("key", F.lit(True).alias("crowd"))
    whole = several.join(classes.where("n > 1").select("key", "cls"), ["key", "cls"], "left_semi")
    reps = classes.join(crowds, "key", "left").select("key", "n", F.coalesce("crowd", F.lit(False)).alias("crowd"), "rep.*")
    lists = reps.groupBy("doc_id", "th").agg(F.collect_list(F.struct("key", "n", "crowd", "lo", "hi")).alias("reps"))
    # not cut off here: this exchange of the texts is the one that the caller's join reuses. A row
    # that repeats doc_id and text is cut twice; its runs have n > 1 then, and serve as partners only
    texts = _beside(d, lists, "inner").select("doc_id", "th", "text", "reps")
    cut = texts.mapInArrow(_cut, "key bigint, n bigint, crowd boolean, lo bigint, run binary, doc_id bigint, th bigint")
    few = cut.where("NOT crowd").drop("crowd").repartition("key").sortWithinPartitions("key")
    settled = few.mapInArrow(_settle, "doc_id bigint, th bigint, lo bigint, hi bigint")
    spans = met.where("NOT several").select(*span).union(whole.select(*span)).union(settled)
    if crowds.isEmpty():
        return spans
    single = cut.where("crowd").drop("crowd").mapInArrow(_one_by_one, "key bigint, n bigint, doc_id bigint, th bigint, lo bigint, print bigint")
    again = single.groupBy("key", "print").count().where(F.col("count") > 1).select("key", "print")
    spread = single.where("n = 1").join(again, ["key", "print"], "left_semi").select(*span[:3], (F.col("lo") + LENGTH).alias("hi"))
    return spans.union(spread)


def remove_repeats(docs: DataFrame, batches: int = BATCHES, crowd: int = CROWD) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, spans (removed [from, to) in bytes), kept (binary)."""
    found = repeated_spans(docs, batches, crowd)
    lists = found.groupBy("doc_id", "th").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    out = _beside(_prepared(docs), lists, "left").select("doc_id", "text", "spans")
    return out.mapInArrow(_finish, "doc_id bigint, n_bytes bigint, n_removed bigint, spans array<array<bigint>>, kept binary")


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    r = remove_repeats(docs, **options)
    return r.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

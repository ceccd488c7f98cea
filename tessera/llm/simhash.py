"""SimHash near-dedup with pigeonring candidate filtering.

Fingerprints are 64-bit SimHashes over word shingles (XXH64, seed 42). Two
fingerprints that differ in at most ``max_bits`` = t bits are linked; linked
documents and all they reach form a group.

Filter: the bits are cut into m = t + 1 segments that stand in a ring. If two
fingerprints differ in at most t bits, there is a segment from which every chain
of l consecutive segments differs in at most floor(l * t / m) bits. The first
chain has budget 0 and the second at most 1, so each fingerprint is filed for
each start segment under that segment's bits and the first k bits of the next
one, and visits the k cells that differ in one of those bits. k grows with the
logarithm of the number of fingerprints, so cells stay small at any size. Pairs
that meet in a cell must keep the budget of every longer chain; only then is the
full distance taken.

Large cells (near copies by the thousand) are dealt into sub-blocks that are
compared block against block in separate tasks, and a task returns a spanning
forest of the links it found, never the pairs.

Defined results: a null or empty text has fingerprint zero, linked like any
other; equal fingerprints are one node; a null doc_id counts as no id (a group of
only such has a null component_id); rows that repeat a doc_id are reported each,
and ``dedup`` leaves one; an empty table gives an empty result. Only doc_id and
text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import components, packed
from tessera.session import cut_lineage

SHINGLE = 4
MAX_BITS = 4
SEED = 42
#: Rows a block of a large cell holds; larger cells are compared block by block.
CELL_ROWS = 1024


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a text."""
    words = (text or b"").lower().split()  # ASCII letters and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        parts = [joined]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1]
        parts = [joined[a:b] for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist())]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(p, SEED) for p in parts), np.uint64, len(parts))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            texts = b.column("text").cast(pa.binary()).to_pylist()
            fps = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id bigint, fp bigint")


def ring(max_bits: int) -> list[tuple[int, int]]:
    """(offset, width) of the segments."""
    m = max_bits + 1
    cuts = [round(64 * i / m) for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def chain_masks(max_bits: int) -> np.ndarray:
    """masks[i, l-1]: the bits of the l consecutive segments that begin at i."""
    seg = [((1 << w) - 1) << o for o, w in ring(max_bits)]
    m = len(seg)
    return np.array([[sum(seg[(i + j) % m] for j in range(n + 1)) for n in range(m)] for i in range(m)], np.uint64)


def _survivors(a: np.ndarray, b: np.ndarray, start: np.ndarray, masks: np.ndarray, max_bits: int) -> np.ndarray:
    """Which pairs keep every chain's budget and the full distance."""
    m = max_bits + 1
    at = np.arange(len(a))
    x = a ^ b
    for n in range(1, m + 1):
        ok = np.bitwise_count(x[at] & masks[start[at], n - 1]) <= n * max_bits // m
        at = at[ok]
    return at[np.bitwise_count(x[at]) <= max_bits]


def _forest(pairs: np.ndarray) -> list[tuple[int, int]]:
    """The pairs that join two trees (union by smaller root)."""
    root: dict[int, int] = {}

    def find(v):
        while (p := root.setdefault(v, v)) != v:
            root[v] = root[p]
            v = root[v]
        return v

    kept = []
    for u, v in pairs.tolist():
        a, b = find(u), find(v)
        if a != b:
            root[max(a, b)] = min(a, b)
            kept.append((u, v))
    return kept


def _cell_links(fp: np.ndarray, start: int, side: np.ndarray, masks: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Spanning links of one cell or of one pair of its blocks (side: 0, 1)."""
    u = fp.view(np.uint64)
    lone = side.min() == side.max()
    # breadth-first over rows not reached yet: each row is expanded once
    todo = np.ones(len(u), bool)
    links = []
    for s in range(len(u)):
        if not todo[s]:
            continue
        todo[s] = False
        front = [s]
        while front and todo.any():
            v = front.pop()
            cand = np.flatnonzero(todo if lone else todo & (side != side[v]))
            if not len(cand):
                continue
            hit = cand[_survivors(u[cand], np.broadcast_to(u[v], len(cand)), np.full(len(cand), start), masks, max_bits)]
            todo[hit] = False
            links += [(int(fp[v]), int(fp[h])) for h in hit]
            front += hit.tolist()
    return links


def link_forest(fps: DataFrame, n: int, max_bits: int = MAX_BITS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fps`` (fp) whose components are those of all links."""
    segs, masks = ring(max_bits), chain_masks(max_bits)
    m = len(segs)
    k = max(0, min(min(w for _, w in segs), math.ceil(math.log2(max(n, 2))) - segs[0][1] + 1)) if m > 1 and max_bits * 2 // m else 0

    def bits(o, w):
        return F.shiftrightunsigned("fp", o).bitwiseAND(F.lit((1 << w) - 1))

    homes = []
    for i in range(m):
        (o, w), (o2, _) = segs[i], segs[(i + 1) % m]
        own = F.shiftleft(bits(o, w), 16).bitwiseOR(bits(o2, k)) if k else F.shiftleft(bits(o, w), 16)
        own = own.bitwiseOR(F.lit(i << 40))
        homes += [own] + [own.bitwiseXOR(F.lit(1 << j)) for j in range(k)]
    cells = fps.select("fp", F.explode(F.array(*homes)).alias("cell"))
    large = cut_lineage(cells.groupBy("cell").count().where(F.col("count") > cell_rows).select("cell", F.ceil(F.col("count") / cell_rows).cast("int").alias("nb")))
    cells = cells.join(large, "cell", "left").withColumn("blk", F.when(F.col("nb") > 1, F.pmod(F.xxhash64("fp", F.lit(7)), F.col("nb"))).otherwise(0).cast("int"))
    other = F.explode(F.when(F.col("nb") > 1, F.sequence(F.lit(0), F.col("nb") - 1)).otherwise(F.array(F.lit(0))))
    cells = cells.withColumn("other", other).select("fp", "cell", "blk", F.least("blk", "other").alias("x"), F.greatest("blk", "other").alias("y"))
    dealt = cells.repartition("cell", "x", "y").sortWithinPartitions("cell", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]):
        def work(t: pa.Table):
            fp, cell, blk, x, y = (t.column(c).to_numpy() for c in ("fp", "cell", "blk", "x", "y"))
            new = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
            size = np.diff(np.r_[new, len(cell)])
            start, u = cell >> 40, fp.view(np.uint64)
            pairs = []
            small = np.repeat(size, size) <= 48
            group = np.repeat(np.arange(len(new)), size)
            for d in range(1, min(48, int(size.max()))):  # small cells: compare rows a fixed distance apart
                at = np.flatnonzero(small[:-d] & (group[:-d] == group[d:]))
                if not len(at):
                    break
                hit = at[_survivors(u[at], u[at + d], start[at], masks, max_bits)]
                pairs.append(np.stack([fp[hit], fp[hit + d]], 1))
            out = _forest(np.concatenate(pairs)) if pairs else []
            for s, n_rows in zip(new[size > 48].tolist(), size[size > 48].tolist()):
                e = s + n_rows
                out += _cell_links(fp[s:e], int(start[s]), blk[s:e] - x[s:e] if x[s] != y[s] else np.zeros(n_rows, int), masks, max_bits)
            ab = np.array(out, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], ["a", "b"])

        held: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            if held.num_rows < 50_000:
                continue
            c, x, y = (held.column(n).to_numpy() for n in ("cell", "x", "y"))
            same = (c == c[-1]) & (x == x[-1]) & (y == y[-1])
            cut = int(np.argmax(same))  # the last cell may go on in the next batch
            if cut:
                yield work(held.slice(0, cut).combine_chunks())
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield work(held.combine_chunks())

    return dealt.mapInArrow(run, "a bigint, b bigint")


def groups(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id."""
    fps = cut_lineage(fingerprints(docs, shingle))
    nodes = cut_lineage(fps.select("fp").distinct())
    comp = components(link_forest(nodes, nodes.count(), max_bits, cell_rows))
    comp = comp.select(F.col("id").alias("fp"), F.col("component_id").alias("root"))
    per_fp = fps.groupBy("fp").agg(F.min("doc_id").alias("least")).join(comp, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    per_fp = cut_lineage(per_fp)
    roots = per_fp.groupBy("root").agg(F.min("least").alias("component_id"))
    named = per_fp.join(roots, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def dedup(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one document of each group: that of the smallest doc_id.

    Rows without a doc_id stay (nothing tells which document they are).
    """
    ids = groups(docs, shingle, max_bits).where("doc_id = component_id").groupBy(F.col("doc_id").alias("k")).agg(F.count(F.lit(1)).alias("c"))
    ids = cut_lineage(ids)
    rows = packed(docs, i=docs["doc_id"])
    out = rows.join(ids, rows["i"] == ids["k"])
    bare = docs.where("doc_id IS NULL")
    if ids.where("c > 1").isEmpty():
        return out.select("_row.*").unionByName(bare)
    once = out.where("c > 1").dropDuplicates(["i"])
    return out.where("c = 1").select("_row.*").unionByName(once.select("_row.*")).unionByName(bare)

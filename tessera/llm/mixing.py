"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sources, in code point order with null last, weigh 5, 2, 1, repeating. The mix is
as long in words as the corpus; a source's target is its share by weight, held at
``max_epochs`` times its size, the excess shared again by weight until no target
is above (the water level is found in closed form over the table of sources).

A source's documents are permuted by a seeded hash of their id and cut into as
many blocks as a block has documents (the root of the source's count). Whole epochs take every block; the rest of the
target takes blocks in the order of the permutation, and single documents of the
last block, up to the document at which the target is passed nearest. The drawn
blocks of all sources form an urn of exact per-source counts. A binary tree over
the output shards splits it: at each node the number of blocks of each source
that go left is drawn from the multivariate hypergeometric distribution of the
node's counts, so leaf quotas are exact and sum to the urn. Shard s then owns a
range of each source's block permutation, disjoint from all others, and its rows
are ordered by a seeded hash inside the shard.

All draws are seeded hashes of ids, so reruns and recomputed tasks agree.

Defined results: a null text has size 0; a document of size 0 takes 0 words and
no copies; a null source is a source of its own, last; a null doc_id is a
key like any other; rows that repeat a doc_id and size move together; an empty table
gives an empty result. Only doc_id, text and source are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import packed, text_or_empty
from tessera.session import cut_lineage

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
SEED = 20_240_517
#: Average number of blocks an output shard holds.
SHARD_BLOCKS = 64
MAX_SHARDS = 4096


def n_words(name: str = "text"):
    """Number of maximal runs of characters other than space and TAB..CR."""
    return F.regexp_count(text_or_empty(name), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sizes`` (source, source_size, ...: one row per source) plus weight and target."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", w).withColumn("_cap", F.col("source_size") * F.lit(float(max_epochs)))
    s = s.withColumn("_ratio", F.col("_cap") / F.col("weight"))
    # the sources of least cap per weight are held first; _level is what a unit of weight gets of the rest
    everything = Window.partitionBy()
    before = Window.orderBy("_ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    s = s.withColumn("_level", left / weight).withColumn("_held", F.col("_ratio") <= F.col("_level"))
    # behind the first free source all are free, at its level
    first = F.min(F.when(~F.col("_held"), F.struct("_ratio", F.col("_level").alias("level")))).over(everything)
    s = s.withColumn("_first", first)
    free = F.col("_first").isNotNull() & (F.col("_ratio") >= F.col("_first._ratio"))
    return s.withColumn("target", F.when(free, F.col("_first.level") * F.col("weight")).otherwise(F.col("_cap"))).drop("_cap", "_ratio", "_level", "_held", "_first")


def split_tree(urn: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Exact quotas (sources x shards) of the blocks counted in ``urn``.

    Each node hands its counts to two halves of its shards; what goes left is a
    multivariate hypergeometric draw without replacement, the rest goes right.
    """
    quota = np.zeros((len(urn), shards), np.int64)
    stack = [(0, shards, np.asarray(urn, np.int64))]
    while stack:
        lo, hi, counts = stack.pop()
        if hi - lo == 1:
            quota[:, lo] = counts
            continue
        mid = (lo + hi) // 2
        take = int(counts.sum()) * (mid - lo) // (hi - lo)
        draw = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(counts, take, method="marginals")
        stack += [(lo, mid, draw), (mid, hi, counts - draw)]
    return quota


def plan(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED, extra: tuple = ()) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies, shards.

    ``shards`` has the output shard of each copy. ``extra`` names columns of
    ``docs`` to carry along.
    """
    spark = docs.sparkSession
    d = docs.select("doc_id", "source", n_words().alias("size"), *extra)
    d = d.withColumn("_s", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    # permutation of each source's documents: the order of a seeded hash, as a number in [0, 1)
    d = d.withColumn("_p", F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit(seed)), 11) / F.lit(float(1 << 53)))
    slim = cut_lineage(d.select("doc_id", "source", "size", "_s", "_p"))
    sizes = slim.groupBy("source", "_s").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    # as many blocks as documents in a block: both grow with the root of the source
    per = targets(sizes, weights, max_epochs).withColumn("n_blocks", F.ceil(F.sqrt("n_docs")).cast("bigint"))
    per = per.withColumn("epochs", F.coalesce(F.floor(F.col("target") / F.nullif("source_size", F.lit(0))), F.lit(0)))
    per = per.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    per = cut_lineage(per.drop("source", "weight"))
    at = F.floor(F.col("_p") * F.col("n_blocks"))
    rows = slim.join(F.broadcast(per), "_s").withColumn("block", at)
    blocks = rows.groupBy("_s", "block").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("epochs").alias("epochs"))
    ordered = Window.partitionBy("_s").orderBy("block")
    blocks = blocks.withColumn("room", F.col("rest") - F.coalesce(F.sum("words").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    blocks = cut_lineage(blocks.select("_s", "block", "words", "epochs", F.greatest("room", F.lit(0.0)).alias("room")))
    # the urn: every block of every whole epoch, and those that the rest reaches
    draws = F.col("epochs") + F.when(F.col("room") > 0, 1).otherwise(0)
    urn_rows = blocks.select("_s", "block", F.explode(F.when(draws > 0, F.sequence(F.lit(1), draws.cast("int")))).alias("epoch"))
    turn = Window.partitionBy("_s").orderBy(F.xxhash64("epoch", "block", F.lit(seed + 1)), "epoch", "block")
    urn_rows = cut_lineage(urn_rows.withColumn("turn", F.row_number().over(turn)))
    urn = urn_rows.groupBy("_s").count().orderBy("_s").collect()  # one row per source
    total = sum(r["count"] for r in urn)
    n_shards = max(1, min(MAX_SHARDS, total // SHARD_BLOCKS, 4_000_000 // max(1, len(urn))))
    quota = split_tree(np.array([r["count"] for r in urn]), n_shards, seed) if urn else np.zeros((0, 1), np.int64)
    owns = [(r["_s"], int(s), int(b - q), int(b)) for r, line in zip(urn, quota) for s, (q, b) in enumerate(zip(line, np.cumsum(line))) if q]
    owned = spark.createDataFrame(owns, "_s string, shard int, lo bigint, hi bigint")
    owned = owned.select("_s", "shard", F.explode(F.sequence(F.col("lo") + 1, F.col("hi"))).alias("turn"))
    dealt = urn_rows.join(owned, ["_s", "turn"]).groupBy("_s", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("epoch", "shard"))), lambda x: x["shard"]).alias("dealt"))
    dealt = cut_lineage(blocks.join(dealt, ["_s", "block"], "left"))
    # inside the block where the rest ends, documents go in the permuted order until it is passed
    ends = dealt.where((F.col("room") > 0) & (F.col("room") < F.col("words")))
    inner = Window.partitionBy("_s", "block").orderBy("_p", "doc_id", "size")
    keyed = d.join(F.broadcast(per), "_s").withColumn("block", at)
    last = slim.join(F.broadcast(per.select("_s", "n_blocks")), "_s").withColumn("block", at).join(ends.select("_s", "block", "room"), ["_s", "block"])
    last = last.withColumn("_cum", F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") / 2)
    cut = cut_lineage(last.where("_cum > room").groupBy("_s", "block").agg(F.min(F.struct("_p", "doc_id", "size")).alias("stop")))
    dealt = dealt.join(cut, ["_s", "block"], "left").select("_s", "block", F.col("room").alias("_room"), "dealt", "stop")
    out = keyed.join(dealt, ["_s", "block"])
    past = F.col("stop").isNotNull() & (F.struct("_p", "doc_id", "size") >= F.col("stop"))
    whole = F.col("epochs") + F.when((F.col("_room") > 0) & ~past, 1).otherwise(0)
    copies = F.when(F.col("size") > 0, whole).otherwise(0).cast("int")
    out = out.withColumn("copies", copies).withColumn("shards", F.slice(F.coalesce("dealt", F.array().cast("array<int>")), F.lit(1), F.col("copies")))
    return out.select("doc_id", "size", "source_size", "target", "copies", "shards", *extra)


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: the columns of ``docs``, a row for each copy.

    Rows are dealt to shards and shuffled inside each by a seeded hash.
    """
    seed = options.get("seed", SEED)
    rows = packed(docs, doc_id=docs["doc_id"], text=docs["text"], source=docs["source"])
    drawn = plan(rows, extra=("_row",), **options).select("_row", F.posexplode("shards").alias("_copy", "_shard"))
    drawn = drawn.withColumn("_order", F.xxhash64(F.col("_row.doc_id"), F.col("_copy"), F.lit(seed + 2)))
    return drawn.repartition("_shard").sortWithinPartitions("_shard", "_order").select("_row.*")

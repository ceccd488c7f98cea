"""Exact deduplication by deterministic block naming (DataFrame functions only).

The normalised text is cut into blocks of a fixed number of bytes. Distinct
blocks are sorted and numbered, so equal blocks, and only they, share an integer
name. Then adjacent names are paired, the distinct pairs are sorted and numbered
again, and so on until each document has one name. Two documents of the same
number of rounds have the same name if and only if they are equal, with no
reliance on hashes being free of collisions: a 64-bit hash only orders the
blocks and routes them, and blocks that share one are told apart by their bytes.

Defined results: a null text counts as empty; all empty texts are equal; a null
doc_id is the least; rows that repeat both doc_id and text all count in
group_size and are all reported like one another, and ``dedup`` leaves one of
them; an empty table gives an empty result. Only doc_id and text are read, so
further columns, whatever their names, do no harm.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, dense_names, packed, text_or_empty
from tessera.session import cut_lineage

BLOCK_BYTES = 16_384
KEY = ["doc_id", "sha", "n_bytes"]


def _blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """One row per block: the document's key, its number of blocks, index, hash and bytes."""
    d = docs.select("doc_id", ascii_lower(text_or_empty()).cast("binary").alias("t"))
    d = d.select("doc_id", "t", F.octet_length("t").alias("n_bytes"), F.sha2("t", 256).alias("sha"))
    last = F.floor((F.greatest(F.col("n_bytes"), F.lit(1)) - 1) / block_bytes).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(F.col("t"), i * block_bytes + 1, F.lit(block_bytes)))
    rows = d.select(*KEY, (last + 1).alias("n"), F.posexplode(cut).alias("i", "block"))
    return rows.withColumn("h", F.xxhash64("block"))


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, sha (of the normalised text), level, name.

    (level, name) is the collision-free identity.
    """
    blocks = _blocks(docs, block_bytes)
    distinct = blocks.select("h", "block").distinct()
    per_hash = cut_lineage(distinct.groupBy("h").agg(F.count(F.lit(1)).alias("c")))
    shared = per_hash.where("c > 1").select("h")
    ranks = per_hash.select("h", F.explode(F.sequence(F.lit(1), F.col("c").cast("int"))).alias("k"))
    names = dense_names(ranks, ["h", "k"], F.shiftright("h", 52), "name")
    if shared.isEmpty():
        occ = blocks.select(*KEY, "n", "i", "h", F.lit(1).alias("k"))
    else:  # blocks that share a hash: told apart by the order of their bytes
        from pyspark.sql import Window

        told = distinct.join(shared, "h", "left_semi").withColumn("k", F.row_number().over(Window.partitionBy("h").orderBy("block")))
        alike = blocks.join(shared, "h", "left_semi").join(told, ["h", "block"]).select(*KEY, "n", "i", "h", "k")
        occ = blocks.join(shared, "h", "left_anti").select(*KEY, "n", "i", "h", F.lit(1).alias("k")).unionByName(alike)
    level, seq, done = 0, occ.join(names, ["h", "k"]).select(*KEY, "n", "i", "name"), []
    seq = cut_lineage(seq)
    # repeated rows (same doc_id and text) run through the rounds as one and are counted
    while True:
        whole = seq.where("n = 1")
        done.append(whole.select("doc_id", "sha", F.lit(level).alias("level"), "name", *([F.lit(1).cast("bigint").alias("rows")] if level == 0 else ["rows"])))
        rest = seq.where("n > 1")
        if rest.isEmpty():
            break
        if level == 0:
            rest = rest.groupBy(*KEY, "n", "i", "name").agg(F.count(F.lit(1)).alias("rows"))
        pairs = rest.groupBy(*KEY, "n", "rows", F.floor(F.col("i") / 2).cast("int").alias("i")).agg(
            F.max(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("i") % 2 == 1, F.col("name"))), F.lit(0)).alias("b"),
        )
        pairs = cut_lineage(pairs)
        named = dense_names(pairs.select("a", "b").distinct(), ["a", "b"], F.pmod(F.xxhash64("a", "b"), F.lit(4096)), "name")
        seq = cut_lineage(pairs.join(named, ["a", "b"]).select(*KEY, F.ceil(F.col("n") / 2).cast("int").alias("n"), "rows", "i", "name"))
        level += 1
    return reduce(DataFrame.unionByName, done).withColumn("rows", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))).drop("rows")


def groups(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: doc_id, keep_id, group_size, kept, text_sha256."""
    ids = cut_lineage(identities(docs, block_bytes))
    per = ids.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return ids.join(per, ["level", "name"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256")
    )


def dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they were."""
    kept = groups(docs, block_bytes).where("kept").groupBy(F.col("doc_id").alias("k"), F.col("text_sha256").alias("s")).agg(F.count(F.lit(1)).alias("c"))
    kept = cut_lineage(kept)
    rows = packed(docs, i=docs["doc_id"], h=F.sha2(ascii_lower(text_or_empty()).cast("binary"), 256))
    out = rows.join(kept, rows["i"].eqNullSafe(kept["k"]) & (rows["h"] == kept["s"]))
    if kept.where("c > 1").isEmpty():
        return out.select("_row.*")
    once = out.where("c > 1").dropDuplicates(["i", "h"])
    return out.where("c = 1").select("_row.*").unionByName(once.select("_row.*"))

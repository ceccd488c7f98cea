"""Filter interaction audit: every order of five quality filters, folded over mask cells.

A document is a mask of the filters it fails, so the table shrinks to cells
(part, mask) with a count of documents, of good and of toxic ones: at most 32 a
part, summed before anything is shuffled. The 120 orders are one broadcast row
with an array. Higher-order functions fold a cell across each order: ``aggregate``
walks its five steps and ``transform`` does so for all orders, which gives 600
weighted structs, and the structs of a part's cells are merged by elementwise
sums. No task holds more than the cells of a part, however many documents it has.

Filter E (a copy of an earlier text) needs no row-level join: the rows that pass
it are those of the smallest doc_id of each text, and they come from a partial
minimum per digest of the text (SHA-256), so a text that a third of all rows share
is one value per task. Rows that fail are the rest of their cell.

Defined results: a null text is an empty one (0 words: fails A alone, or A and E);
a null source and an empty one are the part ''. A null doc_id is neither smaller
nor larger than another, so such a row passes E and hides no other. Rows that
repeat a doc_id are documents of their own; with the same text none is the
smaller. A document is good (toxic) if any of its rows in ``labels`` has quality
(toxic) 1; null ids match no label. An empty table gives no rows. Only doc_id,
text, source and doc_id, quality, toxic of the labels are read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACES, text_or_empty
from tessera.session import cut_lineage

FILTERS = "ABCDE"
#: Bounds of the filters A to C and the marks of D.
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITAL_PERCENT = 2
MARKS = r"[#$%&*|]"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def failures(text: Column) -> Column:
    """Bits 0 to 3: whether the text fails A to D."""
    words = F.array_remove(F.split(text, SPACES), "")
    n = F.size(words)
    tests = (
        n < MIN_WORDS,
        F.size(F.array_distinct(words)) * 100 < n * MIN_DISTINCT_PERCENT,
        F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("bigint") * 100 > F.length(text).cast("bigint") * MAX_CAPITAL_PERCENT,
        text.rlike(MARKS),
    )
    bits = [t.cast("int") * (1 << k) for k, t in enumerate(tests)]
    return bits[0] + bits[1] + bits[2] + bits[3]


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, part, digest of the text, mask of A to D, good and toxic (0 or 1)."""
    marks = labels.where((F.col("quality") == 1) | (F.col("toxic") == 1)).groupBy(F.col("doc_id").alias("_id"))
    marks = marks.agg(*[F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(a) for c, a in (("quality", "good"), ("toxic", "toxic"))])
    text = text_or_empty()
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), failures(text).alias("mask"))
    return rows.join(marks, rows["doc_id"] == marks["_id"], "left").select(
        "doc_id", "part", "digest", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")
    )


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask of A to E, n, n_good, n_toxic), all counts positive or zero."""
    rows = cut_lineage(flagged(docs, labels))  # a hundred bytes a document; texts are read once
    kinds = ["part", "mask", "good", "toxic"]
    every = rows.groupBy(*kinds).agg(F.count(F.lit(1)).alias("n"))
    # rows that repeat a doc_id stand together: one entry per source, then the smallest doc_id of a text
    same = ["digest", "doc_id", "mask", "good", "toxic"]
    ids = rows.where("doc_id IS NOT NULL").groupBy(*same, "part").agg(F.count(F.lit(1)).alias("n"))
    ids = ids.groupBy(*same).agg(F.collect_list(F.struct("part", "n")).alias("parts"))
    first = ids.groupBy("digest").agg(F.min_by(F.struct("mask", "good", "toxic", "parts"), "doc_id").alias("r"))
    first = first.select("r.mask", "r.good", "r.toxic", F.inline("r.parts")).select(*kinds, "n")
    passing = first.unionByName(rows.where("doc_id IS NULL").select(*kinds, F.lit(1).cast("bigint").alias("n")))
    passing = passing.groupBy(*kinds).agg(F.sum("n").alias("n"))  # read twice, and a few rows
    copy = 1 << FILTERS.index("E")
    failing = every.unionByName(passing.withColumn("n", -F.col("n"))).withColumn("mask", F.col("mask") + copy)
    split = passing.unionByName(failing)
    split = split.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("n_good"), F.sum(F.col("n") * F.col("toxic")).alias("n_toxic"))
    return split.where("n > 0")


def orders() -> Column:
    """All orders, each as a name and the indexes of its filters: one array literal that goes to every task with the plan."""
    rows = [F.struct(F.lit("".join(p)).alias("name"), F.array(*[F.lit(FILTERS.index(f)) for f in p]).alias("steps")) for p in permutations(FILTERS)]
    return F.array(*rows)


def folded(cell: Column, all_orders: Column) -> Column:
    """The 600 structs of a cell: per order and step the filter and the six counts."""
    zero = F.lit(0).cast("bigint")

    def walk(steps: Column) -> Column:
        def step(acc, f):
            bit = F.call_function("shiftleft", F.lit(1), f)
            fails, gone = cell["mask"].bitwiseAND(bit) != 0, acc["gone"]
            removed = fails & ~gone
            counts = (
                F.when(fails | gone, zero).otherwise(cell["n"]),
                F.when(removed, cell["n"]).otherwise(zero),
                F.when(fails & gone, cell["n"]).otherwise(zero),
                F.when(cell["mask"] == bit, cell["n"]).otherwise(zero),
                F.when(removed, cell["n_good"]).otherwise(zero),
                F.when(removed, cell["n_toxic"]).otherwise(zero),
            )
            row = F.struct(f.alias("f"), *[c.alias(name) for c, name in zip(counts, COUNTS)])
            return F.struct((gone | fails).alias("gone"), F.concat(acc["out"], F.array(row)).alias("out"))

        start = F.struct(F.lit(False).alias("gone"), F.array().cast(ROWS).alias("out"))
        return F.aggregate(steps, start, step, lambda acc: acc["out"])

    return F.flatten(F.transform(all_orders, lambda o: walk(o["steps"])))


ROWS = "array<struct<f:int," + ",".join(f"{c}:bigint" for c in COUNTS) + ">>"


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, filter order and step with its counts and its filter's Shapley sum."""

    def added(a, b):
        return F.struct(a["f"].alias("f"), *[(a[c] + b[c]).alias(c) for c in COUNTS])

    def none(cell):
        return F.struct(cell["mask"].alias("mask"), *[F.lit(0).cast("bigint").alias(c) for c in ("n", "n_good", "n_toxic")])

    parts = cells(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "n_good", "n_toxic")).alias("cells"))
    parts = parts.withColumn("orders", orders())
    start = folded(none(F.col("cells")[0]), F.col("orders"))
    sums = F.aggregate("cells", start, lambda acc, cell: F.zip_with(acc, folded(cell, F.col("orders")), added))
    n = len(FILTERS)

    def lines(sums):
        def removed(k):
            return F.aggregate(F.filter(sums, lambda s: s["f"] == k), F.lit(0).cast("bigint"), lambda acc, s: acc + s["removed"])

        def named(s, at):
            order = F.get(F.col("orders"), F.floor(at / n).cast("int"))["name"]
            return order.alias("filter_order"), (at % n + 1).cast("int").alias("step")

        def line(shares):
            return F.transform(sums, lambda s, at: F.struct(*named(s, at), *[s[c].alias(c) for c in COUNTS], F.get(shares, s["f"]).alias("shapley")))

        return let(F.transform(F.array(*[F.lit(k) for k in range(n)]), removed), line)

    # the outer form keeps the planner from evaluating the sums once more for a filter on their size
    return parts.select("part", F.inline_outer(let(sums, lines)))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value taken once: a lambda's argument is not copied into its body."""
    return F.get(F.transform(F.array(value), use), F.lit(0))

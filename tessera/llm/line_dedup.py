"""Near-duplicate lines by a segment-partition edit join (DataFrame functions only).

Lines are what stands between line breaks; blank ones (spaces only) are left out.
Equal lines are one class. Two classes are linked if both have at least
``MIN_CHARS`` characters and their edit distance is at most ``MAX_EDITS`` = t
(insertions, deletions, substitutions of characters).

Each line is cut into t + 1 even segments, filed under (number of segment, length
of the line, characters of the segment). t edits leave one segment whole, so a
line of length l finds its partners of length l - t .. l by looking up, for each of
these lengths and each segment, those of its substrings that start where the
segment could have moved to when its side edits are counted (multi-match-aware
selection). A line becomes a row for each place first and keys are made after that, by one
short expression that Spark compiles. Segments are cut from a copy of 4 bytes a character, where a place needs no
search. A lookup also compares counts of letters (modulo 4, in groups), which t
edits change by 2t steps at most; they are taken once per line. Pairs that meet are verified by a banded bit-parallel
edit distance: the rows of a band around the diagonal are bits of a long, and a
fold over the characters advances all of them at once.

Classes are named by a 64-bit hash of the line; should two different lines share one,
the run stops with an error that asks for another ``salt``.

Defined results: a null or empty text has no lines; a line's place is its number in
its text, from 0, blank lines counted; null doc_ids come first in order; rows that
repeat a doc_id contribute all their lines; an empty table gives an empty result.
Only doc_id and text are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import components, text_or_empty
from tessera.session import cut_lineage

MAX_EDITS = 2
MIN_CHARS = 24
#: Groups of letters whose counts travel with a filed segment: 2 bits each under a 40-bit key.
LETTERS = ("e", "a", "i", "o", "t", "n", "s", "r", "lb", "dm", "uc", "hp")
KEY_BITS = 40


def _lines(docs: DataFrame, salt: int) -> DataFrame:
    """doc_id, line_no, line, id of every line that is not blank."""
    d = docs.select("doc_id", F.posexplode(F.split(text_or_empty(), "\n")).alias("line_no", "line"))
    return d.where(F.trim("line") != "").withColumn("id", F.xxhash64("line", F.lit(salt)))


def _filed(i: Column | int, n: Column, start: Column, size: Column) -> Column:
    return F.xxhash64(F.lit(i), n, F.substring(F.col("chars"), 4 * start - 3, 4 * size))


def _segments(edits: int) -> list[tuple[int, int, int]]:
    """What is filed: (number of the segment from 1, by how much the line looked for is shorter, shift), nothing moved."""
    return [(i, 0, 0) for i in range(1, edits + 2)]


def _probes(edits: int) -> list[tuple[int, int, int]]:
    """What is looked up: the segments of lines up to ``edits`` shorter, wherever side edits can have moved them."""
    out = []
    for less in range(edits + 1):
        for i in range(1, edits + 2):
            low, high = max(-(i - 1), less - (edits + 1 - i)), min(i - 1, less + (edits + 1 - i))
            out += [(i, less, shift) for shift in range(low, high + 1)]
    return out


def _letters() -> Column:
    """Counts of groups of letters modulo 4, two bits each; each edit changes two counts at most.

    Each group is taken out of what the groups before it left, so later ones search shorter texts.
    """
    rest, counts = F.col("line"), []
    for group in LETTERS:
        before = F.octet_length(rest)
        rest = reduce(lambda s, c: F.replace(s, F.lit(c), F.lit("")), group, rest)
        counts.append((before - F.octet_length(rest)) % 4)
    return reduce(Column.bitwiseOR, [F.shiftleft(n.cast("bigint"), 2 * k) for k, n in enumerate(counts)])


def _letters_apart(a: Column, b: Column) -> Column:
    """At most this many unit changes of the counts, by their remainders."""

    def one(k):
        d = F.abs(F.shiftrightunsigned(a, 2 * k).bitwiseAND(F.lit(3)) - F.shiftrightunsigned(b, 2 * k).bitwiseAND(F.lit(3)))
        return F.least(d, 4 - d)

    return reduce(Column.__add__, [one(k) for k in range(len(LETTERS))])


def candidates(lines: DataFrame, edits: int) -> DataFrame:
    """(a, b) of lines (id, line, letters) that share a filed segment; each pair once, a < b."""
    base = lines.select("id", F.length("line").cast("int").alias("n"), "letters", F.encode("line", "UTF-32").alias("chars"))
    # key and letters in one long: a shuffled row is two longs
    low = 64 - KEY_BITS

    def filed(name, places, row):
        # a row for each place first, then one short key expression: all keys in one expression are more than the compiler takes
        each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(less).alias("less"), F.lit(shift).alias("shift")) for i, less, shift in places]))
        at = base.select("id", "n", "letters", "chars", each.alias("p")).select("id", "n", "letters", "chars", "p.*")
        at = at.withColumn("m", F.col("n") - F.col("less"))
        at = at.withColumn("more", F.col("m") % (edits + 1)).withColumn("short", F.lit(edits + 1) - F.col("more"))  # the first segments are the shorter ones
        at = at.withColumn("base", ((F.col("m") - F.col("more")) / (edits + 1)).cast("int"))
        start = F.lit(1) + F.col("base") * (F.col("i") - 1) + F.greatest(F.lit(0), F.col("i") - 1 - F.col("short")) + F.col("shift")
        at = at.withColumn("start", start).withColumn("size", F.col("base") + (F.col("i") > F.col("short")).cast("int"))
        at = at.where((F.col("start") >= 1) & (F.col("start") + F.col("size") - 1 <= F.col("n")))
        key = _filed(F.col("i"), F.col("m"), F.col("start"), F.col("size"))
        return at.select(F.col("id").alias(name), F.shiftleft(key, low).bitwiseOR(F.col("letters")).alias(row))

    left, right = filed("a", _segments(edits), "x"), filed("b", _probes(edits), "y")
    same = F.shiftrightunsigned("x", low) == F.shiftrightunsigned("y", low)
    met = left.join(right, same & (F.col("a") != F.col("b")) & (_letters_apart(F.col("x"), F.col("y")) <= 2 * edits))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def edit_distance_within(s: Column, t: Column, edits: int) -> Column:
    """Edit distance of s and t if it is at most ``edits``, else some greater number.

    Bit 61 stands for the row ``edits`` below the diagonal, lower bits for the rows
    above it. The longer text gives the rows.
    """
    rows = F.split(F.when(F.length(s) >= F.length(t), s).otherwise(t), "")
    cols = F.split(F.when(F.length(s) >= F.length(t), t).otherwise(s), "")
    n_rows = F.greatest(F.length(s), F.length(t))
    top, mask = 61, (1 << 62) - 1
    start = F.struct(  # d: distance of the row that is followed, from its place in column 0
        F.lit(0).alias("j"),
        F.lit(((1 << (edits + 1)) - 1) << (top - edits)).cast("bigint").alias("vp"),
        F.lit(0).cast("bigint").alias("vn"),
        F.least(F.lit(edits), n_rows.cast("int")).alias("d"),
    )

    def let(value, use):  # takes a value once
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def advance(acc, c, rows_, n_):
        j = acc["j"]
        matches = [
            F.when(F.get(rows_, j + k) == c, F.lit(1 << (top - edits + k)).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
            for k in range(-edits, edits + 1)
        ]
        x = reduce(Column.bitwiseOR, matches)

        def with_x(x_):
            d0 = (x_.bitwiseAND(acc["vp"]) + acc["vp"]).bitwiseXOR(acc["vp"]).bitwiseOR(x_).bitwiseOR(acc["vn"]).bitwiseAND(F.lit(mask))
            return let(d0, with_d0)

        def with_d0(d0):
            hp = acc["vn"].bitwiseOR(F.bitwise_not(d0.bitwiseOR(acc["vp"])).bitwiseAND(F.lit(mask)))
            return let(hp, lambda h: with_hp(d0, h))

        def with_hp(d0, hp):
            hn = d0.bitwiseAND(acc["vp"])
            low = F.shiftright(d0, 1)
            vp = hn.bitwiseOR(F.bitwise_not(low.bitwiseOR(hp)).bitwiseAND(F.lit(mask)))
            vn = low.bitwiseAND(hp)
            # down the diagonal until the last row enters the band, then along that row
            diagonal = F.when(d0.bitwiseAND(F.lit(1 << top)) == 0, 1).otherwise(0)
            bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.lit(top) + n_ - j - edits - 1).cast("int"))
            along = F.when(hp.bitwiseAND(bit) != 0, 1).otherwise(0) - F.when(hn.bitwiseAND(bit) != 0, 1).otherwise(0)
            return F.struct(
                (j + 1).alias("j"), vp.alias("vp"), vn.alias("vn"), (acc["d"] + F.when(j < n_ - edits, diagonal).otherwise(along)).cast("int").alias("d")
            )

        # beyond reach: what is left can lower the distance by at most 2 * edits
        return F.when(acc["d"] > 3 * edits, acc).otherwise(let(x, with_x))

    bound = F.struct(rows.alias("rows"), n_rows.alias("n"))
    return let(bound, lambda m: F.aggregate(cols, start, lambda acc, c: advance(acc, c, m["rows"], m["n"]), lambda acc: acc["d"]))


def links(docs: DataFrame, edits: int = MAX_EDITS, min_chars: int = MIN_CHARS, salt: int = 0) -> DataFrame:
    """(a, b), a < b: ids of distinct lines within ``edits`` of each other."""
    long = _lines(docs, salt).where(F.length("line") >= min_chars).select("id", "line")
    # one exchange of the distinct lines serves the files, the lookups and the check
    # (one struct: a consumer that left out a column of its own would get an exchange of its own)
    lines = long.withColumn("letters", _letters()).groupBy("id").agg(F.first(F.struct("line", "letters")).alias("l")).select("id", "l.line", "l.letters")
    met = candidates(lines, edits)
    # only the texts of lines that met go on to the check, once for both sides
    ids = met.select(F.col("a").alias("id")).union(met.select(F.col("b").alias("id"))).distinct()
    texts = lines.join(ids, "id", "left_semi").select("id", "line").repartition("id")
    pairs = met.join(texts.select(F.col("id").alias("a"), F.col("line").alias("s")), "a").join(texts.select(F.col("id").alias("b"), F.col("line").alias("t")), "b")
    return pairs.where(edit_distance_within(F.col("s"), F.col("t"), edits) <= edits).select("a", "b")


def classes(docs: DataFrame, edits: int = MAX_EDITS, min_chars: int = MIN_CHARS, salt: int = 0) -> DataFrame:
    """Per line: doc_id, line_no, n_copies (equal lines, itself included), n_links (other
    distinct lines linked), first_doc_id and first_line_no (first place of any line of
    its component), kept (it stands there)."""
    slim = _lines(docs, salt).select("doc_id", "line_no", "id", F.hash("line", F.lit(salt + 1)).alias("h"))
    place = F.struct("doc_id", "line_no")
    per = slim.groupBy("id").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n_copies"), (F.min("h") != F.max("h")).alias("clash"))
    per = cut_lineage(per)
    if not per.where("clash").isEmpty():
        raise ValueError(f"two lines share a hash under salt {salt}; choose another salt")
    found = cut_lineage(links(docs, edits, min_chars, salt))
    both = found.union(found.select("b", "a"))
    degree = both.groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("n_links"))
    comp = components(found).withColumnRenamed("component_id", "root")
    per = per.join(degree, "id", "left").join(comp, "id", "left").withColumn("root", F.coalesce("root", "id"))
    per = cut_lineage(per.select("id", "first", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), "root"))
    roots = per.groupBy("root").agg(F.min("first").alias("least"))
    named = per.join(roots, "root").select("id", "n_copies", "n_links", "least")
    out = slim.select("doc_id", "line_no", "id").join(named, "id")
    kept = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("line_no") == F.col("least.line_no"))
    return out.select("doc_id", "line_no", "n_copies", "n_links", F.col("least.doc_id").alias("first_doc_id"), F.col("least.line_no").alias("first_line_no"), kept.alias("kept"))

"""Block naming against a plain grouping of normalised texts."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import exact_dedup
from tests.llm.helpers import documents


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))


def rows():
    long = "Ab é" * 5000
    return [
        (1, "Hello World"), (2, "hello world"), (3, "HELLO WORLD"), (4, "hello world "), (5, None), (6, ""), (7, "É"), (8, "é"),
        (9, long), (10, long.replace("A", "a")), (11, long + "x"), (12, long[:-1]), (13, long), (13, long), (None, "solo"), (14, "solo"),
        (15, "ab" * 40), (16, "ab" * 39), (17, "ba" * 40), (18, "a" * 64), (19, "a" * 63), (20, "a" * 65),
    ]


@pytest.mark.parametrize("block", [16, 1 << 14])
def test_groups(spark, block):
    data = rows()
    out = exact_dedup.groups(documents(spark, data, clash=True), block_bytes=block).collect()
    by = defaultdict(list)
    for i, t in data:
        by[lower(t)].append(i)
    want = []
    for i, t in data:
        ids = by[lower(t)]
        keep = max((x for x in ids if x is not None), default=None)
        want.append((i, keep, len(ids), i == keep, hashlib.sha256(lower(t).encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, want))


def test_blocks_with_equal_hashes_are_told_apart(spark, monkeypatch):
    real = exact_dedup._blocks
    monkeypatch.setattr(exact_dedup, "_blocks", lambda d, b: real(d, b).withColumn("h", F.col("h") % 3))
    out = exact_dedup.groups(documents(spark, rows()[:12]), block_bytes=16).collect()
    assert {r.doc_id: r.keep_id for r in out} == {1: 3, 2: 3, 3: 3, 4: 4, 5: 6, 6: 6, 7: 7, 8: 8, 9: 10, 10: 10, 11: 11, 12: 12}


def test_dedup_keeps_rows_as_they_are(spark):
    df = documents(spark, rows(), clash=True)
    out = exact_dedup.dedup(df)
    assert out.columns == df.columns
    kept = sorted(-1 if r.doc_id is None else r.doc_id for r in out.collect())
    assert kept == [3, 4, 6, 7, 8, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20]


def test_empty(spark):
    assert exact_dedup.groups(documents(spark, [])).count() == 0
    assert exact_dedup.dedup(documents(spark, [])).count() == 0

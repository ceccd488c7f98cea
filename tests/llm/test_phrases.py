"""Phrase mining against a plain count of all phrases."""

import random
import re
from collections import Counter, defaultdict

import pytest

from tessera.llm import phrases
from tests.llm.helpers import documents


def pieces(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [[w for w in re.split("[ \t]+", p) if w] for p in re.split("[.,;:!?\n\x0b\x0c\r]", low)]


def brute(rows, min_count=30, top=2000, max_words=4):
    f, n = defaultdict(Counter), Counter()
    for r in rows:
        lang = (r[2] if len(r) > 2 else "en") or "und"
        for w in pieces(r[1]):
            n[lang] += len(w)
            for m in range(1, max_words + 1):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, counts in f.items():
        cands = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        scored = []
        for p, a in cands.items():
            if any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= 80 * a for q, b in cands.items()):
                continue
            score, k = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def corpus(seed=4, n=400):
    r = random.Random(seed)
    common = [f"w{i}" for i in range(25)]
    fixed = ["New York city hall", "a b c d e", "x  y\tz", "É é à", "one.two three"]
    rows = []
    for i in range(n):
        words = r.choices(common, k=r.randrange(0, 60))
        for _ in range(r.randrange(0, 3)):
            words.insert(r.randrange(len(words) + 1), r.choice(fixed))
        rows.append((i, r.choice([" ", " ", ", ", "\n"]).join(words), r.choice(["en", "en", "fr", None, "und"])))
    return rows + [(900, None, "en"), (901, "", "fr"), (902, " .,;\n", "en"), (None, "a b c d " * 40, None), (903, "only words " * 3, "tiny"), (903, "only words " * 3, "tiny")]


def mined(spark, rows, clash=False, **options):
    return sorted(map(tuple, phrases.collocations(documents(spark, rows, clash), **options).collect()))


@pytest.mark.parametrize("share", [0.0, 0.3, 1.0])
def test_equals_plain_count_whatever_the_sample(spark, share):
    rows = corpus()
    assert mined(spark, rows, clash=True, sample_share=share) == brute(rows)


def test_failures_of_the_sample_are_expanded(spark):
    """A sample without the phrases: only further passes can find those of 3 and 4 words."""
    rows = corpus(7)
    docs = documents(spark, rows)
    from pyspark.sql import functions as F

    raw = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("raw"), F.lit(False).alias("drawn"))
    raw = phrases.numbered_blocks(raw)
    counts, _, passes = phrases.closed(raw, 30, 4, None)
    assert passes >= 4
    got = {(r.lang, r.phrase): r.f for r in counts.collect()}
    assert len(got) == counts.count()  # no phrase is counted by two passes
    full, _, once = phrases.closed(raw, 30, 4, phrases.closed(raw, 1, 4, None)[1])
    assert once == 1
    assert {(r.lang, r.phrase): r.f for r in full.collect()} == got


def test_a_full_table_of_bits_only_costs_work(spark, monkeypatch):
    monkeypatch.setattr(phrases, "FILTER_BITS", 1 << 15)
    rows = corpus(9, 150)
    assert mined(spark, rows, sample_share=0.5) == brute(rows)


def test_small_blocks_and_one_long_text(spark, monkeypatch):
    rows = [(1, "alpha beta gamma. " * 3000 + "tail", "en"), (2, "alpha beta " * 50, "en")]
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 1 << 10)
    block = list(phrases._pieces(rows[0][1].encode()))
    assert len(block) > 40 and sum(len(p.replace(b".", b" ").split()) for p in block) == 9001
    assert mined(spark, rows) == brute(rows)


def test_ties_limits_and_empty_table(spark):
    rows = [(i, "p q. r s. t u! v w", "en") for i in range(31)]
    assert mined(spark, rows, top=3) == brute(rows, top=3)
    assert [x[2] for x in mined(spark, rows, top=3)] == ["p q", "r s", "t u"]
    assert mined(spark, []) == []
    assert mined(spark, [(1, "a b c", "en")]) == []


def test_counts_by_hash_travel_as_four_bytes_a_phrase():
    import numpy as np

    rng = np.random.default_rng(1)
    drawn = rng.integers(0, 1 << (phrases.BUCKET_BITS + 32), 20_000, dtype=np.uint64)
    keys, counts = phrases._summed([drawn, drawn[:5_000]], [np.ones(20_000, np.int64), np.full(5_000, 2)])
    assert len(keys) == len(set(drawn.tolist())) and counts.sum() == 30_000
    b = phrases.hash_buckets(keys, counts)
    assert b.num_rows <= 1 << phrases.BUCKET_BITS and sum(len(k) for k in b.column("k").to_pylist()) == 4 * len(keys)
    back = [(x << 32) | int(k) for x, ks in zip(b.column("bucket").to_pylist(), b.column("k").to_pylist()) for k in np.frombuffer(ks, np.uint32)]
    assert back == keys.tolist()
    assert np.concatenate([np.frombuffer(n, np.int32) for n in b.column("n").to_pylist()]).tolist() == counts.tolist()


def test_phrases_of_one_hash_are_counted_apart(monkeypatch):
    import numpy as np

    monkeypatch.setattr(phrases, "_joined", lambda h, last: np.zeros(len(h), np.uint64))  # all phrases share a hash
    block = phrases.Block()
    block.add("x", b"a b a b c. a b c")
    row = block.packed(True).to_pylist()[0]
    every = np.full(phrases.FILTER_BITS // 8, 255, np.uint8)
    found = {}
    for batch in phrases.phrase_rows(row, every, None, every, True, 2):
        for r in batch.to_pylist():
            found[r["phrase"]] = found.get(r["phrase"], 0) + r["f"]
    assert found == {"": 8, "a": 3, "b": 3, "c": 2, "a b": 3, "b a": 1, "b c": 2}

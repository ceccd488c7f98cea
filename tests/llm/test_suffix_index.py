"""Repeated passages against a count of every 200-byte string."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import suffix_index
from tests.llm.helpers import documents

L = suffix_index.LENGTH


def brute(rows):
    texts = [(i, (t or "").encode()) for i, t in rows]
    n = Counter(t[p : p + L] for _, t in texts for p in range(len(t) - L + 1))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - L + 1):
            if n[t[p : p + L]] > 1:
                gone[p : p + L] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        kept = bytes(x for x, g in zip(t, gone) if not g)
        out.append((-1 if i is None else i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus():
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdeéfghß"), int(rng.integers(2, 8)))) for _ in range(300)]

    def text(n):
        return " ".join(rng.choice(words, n))

    rows = [(i, text(int(rng.integers(5, 150)))) for i in range(40)]
    passage, other = text(60), text(45)
    rows += [(100 + i, text(int(rng.integers(0, 30))) + " " + passage + " " + text(int(rng.integers(0, 30)))) for i in range(25)]
    rows += [(200, rows[0][1] * 3), (201, rows[3][1]), (202, passage[7:] + other + passage[: len(passage) - 3]), (203, other)]
    exact = text(80).encode()[:210].decode("utf-8", "ignore")
    rows += [(210, "x" + exact[:190] + "y"), (211, "z" + exact[:190] + "w")]
    rows += [(220, "ab" * 400), (221, "a" * 199), (222, "a" * 199), (223, "c" * 200), (224, "c" * 201), (225, None), (226, ""), (None, rows[5][1]), (227, "d" * 200), (227, "d" * 200)]
    cut = text(200)
    rows += [(300 + i, cut[i * 7 : 700 + i * 11]) for i in range(30)]
    return rows


@pytest.mark.parametrize(("batches", "crowd"), [(4, 512), (3, 2)])
def test_equals_brute_force(spark, batches, crowd, monkeypatch):
    rows = corpus()
    out = suffix_index.report(documents(spark, rows, clash=True), batches=batches, crowd=crowd).collect()
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out)
    want = brute(rows)
    assert [g for g, w in zip(got, want) if g != w] == []
    assert len(got) == len(want)
    assert spark.sql("SHOW TABLES LIKE 'suffix_*'").count() == 0


def test_runs_across_slices(monkeypatch):
    """A long text gives the same windows however it is sliced."""
    monkeypatch.setattr(suffix_index, "SLICE_BYTES", 1000)
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 123, n, dtype=np.uint8)) for n in (50, 3000, 199, 200, 777)]
    r = suffix_index.runs(texts)
    for i, t in enumerate(texts):
        got = sorted(p for a, b in zip(r["lo"][r["text"] == i], r["hi"][r["text"] == i]) for p in range(a, b + 1))
        assert got == list(range(max(0, len(t) - L + 1)))


def test_empty_table(spark):
    assert suffix_index.report(documents(spark, [])).count() == 0


@pytest.mark.parametrize("step", ["_entries", "_occurrences", "_finish"])
def test_a_task_holds_few_texts_at_a_time(step):
    import tracemalloc

    rng = np.random.default_rng(3)
    texts = [rng.integers(97, 123, 2000, dtype=np.uint8).tobytes().decode() for _ in range(8000)]
    n = len(texts)
    spans = pa.array([[{"lo": 0, "hi": 250}]] * n)
    b = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(range(n)), pa.array(texts), spans], ["doc_id", "th", "text", "spans"])
    del texts, spans
    suffix_index.Prints(np.zeros(1, np.uint8))  # its tables stay
    tracemalloc.start()
    rows = sum(out.num_rows for out in getattr(suffix_index, step)(iter([b])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows >= n and peak < 28e6

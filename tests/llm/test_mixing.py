"""Mixing: targets by repeated resharing, exact quotas, disjoint blocks, reruns."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import mixing
from tests.llm.helpers import documents


def brute_targets(sizes):
    """Shares by weight; the excess over three times the size is shared again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, held = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in held]
        left = total - sum(held.values())
        t = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if t[s] > 3 * sizes[s]]
        if not over:
            return {**held, **t}
        held |= {s: 3 * sizes[s] for s in over}


def corpus(seed=0, n=1500):
    rng = np.random.default_rng(seed)
    sources = ["b", "a", "ü", None, "tiny", "z"]
    p = [0.5, 0.1, 0.15, 0.1, 0.01, 0.14]
    return [(i, " \t".join(["w"] * int(rng.integers(0, 120))), "en", sources[int(rng.choice(6, p=p))]) for i in range(n)]


def test_targets_and_takes(spark):
    rows = corpus()
    rows += [(9000, None, "en", "a"), (9001, "", "en", "z"), (9002, "w " * 30000, "en", "b"), (None, "one two", "en", "a"), (5, "w w", "en", rows[5][3])]
    out = mixing.plan(documents(spark, rows, clash=True)).collect()
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len((t or "").split())
    want = brute_targets(sizes)
    assert len(out) == len(rows)
    source = {r[0]: r[3] for r in rows}
    taken = Counter()
    for r in out:
        s = source[r.doc_id]
        assert r.source_size == sizes[s]
        assert abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert 0 <= r.copies <= 3 and len(r.shards) == r.copies
        taken[s] += r.size * r.copies
    for s, t in want.items():  # off by about half a document at most
        longest = max(len((r[1] or "").split()) for r in rows if r[3] == s)
        assert abs(taken[s] - t) <= longest
    again = mixing.plan(documents(spark, list(reversed(rows))).repartition(7)).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, again))


def test_mix_rows(spark):
    df = documents(spark, corpus(1, 400), clash=True)
    out = mixing.mix(df)
    assert out.columns == df.columns
    want = {r.doc_id: r.copies for r in mixing.plan(df).collect() if r.copies}
    assert Counter(r.doc_id for r in out.collect()) == want


@pytest.mark.parametrize("shards", [1, 2, 7, 64])
def test_split_tree(shards):
    urn = np.array([100, 3, 0, 51])
    q = mixing.split_tree(urn, shards, 3)
    assert (q >= 0).all() and (q.sum(1) == urn).all()
    assert q.sum(0).max() - q.sum(0).min() <= np.ceil(np.log2(max(shards, 2))) + 1
    assert (q == mixing.split_tree(urn, shards, 3)).all()


def test_split_is_hypergeometric():
    """Mean and variance of what the first of two shards gets."""
    urn, draws = np.array([30, 20, 10]), []
    for seed in range(4000):
        draws.append(mixing.split_tree(urn, 2, seed)[:, 0])
    d = np.array(draws)
    p = urn / 60
    assert np.abs(d.mean(0) - 30 * p).max() < 0.15
    assert np.abs(d.var(0) - 30 * p * (1 - p) * 30 / 59).max() < 0.3


def test_empty(spark):
    assert mixing.plan(documents(spark, [])).count() == 0
    assert mixing.mix(documents(spark, [(1, None), (2, "")])).count() == 0

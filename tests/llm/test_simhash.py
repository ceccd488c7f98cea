"""SimHash near-dedup against brute force over all pairs."""

import numpy as np
import pytest
import xxhash

from tessera.llm import simhash
from tests.llm.helpers import documents


def brute_fp(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_components(ids, fps, bits=4):
    root = list(range(len(ids)))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return [least[find(i)] for i in range(len(ids))]


def test_fixture_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(vocab, 120)) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(30, 120):
        w = base[i % 30].split()
        for _ in range(int(rng.integers(0, 3))):
            w[int(rng.integers(len(w)))] = "zz"
        rows.append((i, " ".join(w)))
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "One two"), (204, "ONE  two"), (205, "a b c d"), (206, "long " * 30000)]
    out = simhash.groups(documents(spark, rows, clash=True), cell_rows=16).toPandas().set_index("doc_id")
    fps = [brute_fp(t) for _, t in rows]
    want = brute_components([i for i, _ in rows], fps)
    for (i, _), fp, comp in zip(rows, fps, want):
        assert out.loc[i, "fingerprint"] == f"{fp:016x}"
        assert out.loc[i, "component_id"] == comp
    kept = {r.doc_id for r in simhash.dedup(documents(spark, rows)).collect()}
    assert kept == set(want)


@pytest.mark.parametrize("cell_rows", [4, 4096])
def test_dense_fingerprints(spark, cell_rows):
    """Links in crowded cells, at the bit limit and just beyond it."""
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 2**63, 6)
    fps = set()
    for c in centre.tolist():
        for _ in range(60):
            fps.add(c ^ sum({1 << int(b) for b in rng.integers(0, 63, int(rng.integers(0, 6)))}))
    fps = sorted(fps)
    df = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    links = {(r.a, r.b) for r in simhash.link_forest(df, len(fps), cell_rows=cell_rows).collect()}
    assert all((a ^ b).bit_count() <= 4 for a, b in links)
    comp = {r.id: r.component_id for r in simhash.components(spark.createDataFrame(list(links), "a bigint, b bigint")).collect()}
    want = brute_components(fps, fps)
    assert [comp.get(f, f) for f in fps] == want


def test_empty_nulls_and_repeats(spark):
    assert simhash.groups(documents(spark, [])).count() == 0
    rows = [(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (None, None)]
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.groups(documents(spark, rows)).collect() if r.component_id)
    assert got == [(-1, 7), (7, 7), (7, 7)]
    assert sorted((r.doc_id or -1) for r in simhash.dedup(documents(spark, rows)).collect()) == [-1, -1, 7]

"""Quality scores (C9, C10, C13, C14, C16) against numpy brute force and goldens."""

import numpy as np
import pandas as pd
import pytest

from conftest import golden30, vec_frame
from tessera.operators import quality as Q
from tessera.operators.prepare import prepare_matrix
from tessera.spec import MUSIC


def brute_silhouette(x, y):
    """Mean Euclidean silhouette over rows with label >= 0; singletons score 0."""
    keep = y >= 0
    x, y = x[keep], y[keep]
    if len(set(y)) < 2:
        return 0.0
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    s = np.zeros(len(x))
    for i in range(len(x)):
        own = (y == y[i])
        if own.sum() == 1:
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, y == c].mean() for c in set(y) if c != y[i])
        s[i] = (b - a) / max(a, b) if max(a, b) > 0 else 0.0
    return float(s.mean())


def brute_ari(a, b):
    from math import comb

    ct = pd.crosstab(a, b).to_numpy()
    sij = sum(comb(int(v), 2) for v in ct.ravel())
    sa = sum(comb(int(v), 2) for v in ct.sum(1))
    sb = sum(comb(int(v), 2) for v in ct.sum(0))
    exp = sa * sb / comb(len(a), 2)
    mx = (sa + sb) / 2
    return 1.0 if mx == exp else (sij - exp) / (mx - exp)


def test_silhouette_golden_30_rows(spark):
    pm = prepare_matrix(spark.createDataFrame(golden30()), MUSIC)
    v = pm.vectors().toPandas().sort_values("row_id")
    labels = (np.arange(30) >= 15).astype(int)  # rows are in file order: 15 mellow, 15 upbeat
    x = np.stack(v["x"].to_numpy())
    df = vec_frame(spark, x, labels)
    assert Q.silhouette(df) == pytest.approx(0.567, abs=5e-4)


def test_silhouette_matches_brute_force_with_noise_and_singleton(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(70, 3))
    y = rng.integers(0, 3, size=70)
    y[:5] = -1  # noise rows are left out
    y[5] = 7  # a singleton cluster scores 0
    df = vec_frame(spark, x, y)
    assert Q.silhouette(df, block_rows=16) == pytest.approx(brute_silhouette(x, y), abs=1e-9)


def test_multi_silhouette_one_pass(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(50, 2))
    labs = [rng.integers(0, k, size=50) for k in (2, 3, 4)]
    pdf = pd.DataFrame({"row_id": np.arange(50), "x": [list(r) for r in x], "labs": [list(map(int, t)) for t in zip(*labs)]})
    df = spark.createDataFrame(pdf, "row_id long, x array<double>, labs array<int>")
    got = Q.silhouettes(df, 50, block_rows=8)
    for m, y in enumerate(labs):
        assert got[m] == pytest.approx(brute_silhouette(x, y), abs=1e-9)


def test_ari_and_permutation_invariance(spark):
    rng = np.random.default_rng(5)
    a = rng.integers(0, 4, size=200)
    b = np.where(rng.random(200) < 0.7, a, rng.integers(0, 4, size=200))
    la = spark.createDataFrame(pd.DataFrame({"row_id": np.arange(200), "cluster": a}))
    lb = spark.createDataFrame(pd.DataFrame({"row_id": np.arange(200), "cluster": b}))
    assert Q.ari(la, lb) == pytest.approx(brute_ari(a, b), abs=1e-12)
    perm = spark.createDataFrame(pd.DataFrame({"row_id": np.arange(200), "cluster": (a + 1) % 4}))
    assert Q.ari(la, perm) == pytest.approx(1.0)
    one = spark.createDataFrame(pd.DataFrame({"row_id": np.arange(200), "cluster": np.zeros(200, dtype=int)}))
    assert Q.ari(one, one) == 1.0


def test_ch_cohesion_inertia(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(90, 4))
    y = np.repeat([0, 1, 2], 30)
    x[y == 1] += 3
    df = vec_frame(spark, x, y)
    q = Q.quality_scalars(df, 4)
    mu = x.mean(0)
    cents = np.stack([x[y == c].mean(0) for c in range(3)])
    w = sum(((x[y == c] - cents[c]) ** 2).sum() for c in range(3))
    b = sum((y == c).sum() * ((cents[c] - mu) ** 2).sum() for c in range(3))
    assert q["ch"] == pytest.approx((b / 2) / (w / 87))
    assert q["cohesion"] == pytest.approx(w / 90)


def test_noise_stats(spark):
    lab = spark.createDataFrame([(i, c) for i, c in enumerate([-1, -1, 0, 0, 1, 2])], "row_id long, cluster int")
    r = Q.noise_stats(lab).first()
    assert r["noise_rate"] == pytest.approx(2 / 6) and r["n_clusters"] == 3


@pytest.mark.parametrize("query", ["cluster_silhouette", "kmeans_style_curves", "choose_k_rank_sum"])
def test_silhouette_queries_send_few_copies_of_a_row(spark, query, monkeypatch):
    """as many blocks as cores and memory ask for, not one per 256 rows; of two blocks that meet, both get their sums."""
    import __spark_entry__ as entry
    from tessera.operators import pairs

    met, upper, rows, blocks = [], pairs.cogroup_upper_blocks, [], pairs.n_blocks
    monkeypatch.setattr(pairs, "n_blocks", lambda n, block_rows: rows.append(block_rows) or blocks(n, block_rows))
    monkeypatch.setattr(pairs, "cogroup_upper_blocks", lambda v, b: met.append(b) or upper(v, b))
    assert entry.queries()[query](spark, "/root/testdata/sf0.1").count() > 0
    cores = spark.sparkContext.defaultParallelism
    assert met == [pairs.silhouette_blocks(2000, 64, cores)]
    assert min(rows) >= 1024
    # 600,000 vectors: under 25 copies of each
    assert pairs.silhouette_blocks(600_000, 64, 12) < 25


def test_label_sums_by_small_tiles_equal_brute_force(monkeypatch):
    from tessera.operators import pairs

    r = np.random.default_rng(8)
    x, y = r.normal(size=(600, 4)), r.normal(size=(300, 4)) + 50.0
    hx, hy = np.eye(3)[r.integers(0, 3, 600)], np.eye(2)[r.integers(0, 2, 300)]
    seen, tiles = [], pairs.squared_tiles

    def watched(*args):
        for tile in tiles(*args):
            seen.append(tile[-1].size)
            yield tile

    monkeypatch.setattr(pairs, "squared_tiles", watched)
    d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(-1))
    left, right = pairs._label_sums(x, y, hx, hy, False)
    assert np.allclose(left, d @ hy, rtol=1e-11) and np.allclose(right, d.T @ hx, rtol=1e-11)
    own = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.allclose(pairs._label_sums(x, x, hx, hx, True)[0], own @ hx, rtol=1e-9)
    assert max(seen) <= pairs.TILE**2  # stays in a core's cache

"""Model fits (C1-C8, C12, C16, C17): synthetic blobs, goldens and invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import golden30, three_blobs, vec_frame
from tessera.operators import density as H
from tessera.operators.metric_index import build_index, indexed_knn
from tessera.operators import sweep as W
from tessera.operators.prepare import prepare_matrix
from tessera.plans import clustering as C
from tessera.spec import MUSIC


def brute_ari(a, b):
    import pandas as pd
    from math import comb

    ct = pd.crosstab(a, b).to_numpy()
    sij = sum(comb(int(v), 2) for v in ct.ravel())
    sa = sum(comb(int(v), 2) for v in ct.sum(1))
    sb = sum(comb(int(v), 2) for v in ct.sum(0))
    exp = sa * sb / comb(len(a), 2)
    return (sij - exp) / ((sa + sb) / 2 - exp)


@pytest.fixture(scope="module")
def blobs(spark):
    x, y = three_blobs()
    return x, y, vec_frame(spark, x).cache()


def _labels(res):
    pdf = res.labels.toPandas().sort_values("row_id")
    return pdf


def test_gmm_finds_three_blobs(blobs):
    x, y, v = blobs
    res = C.fit_gmm(v, len(x), 9, range(2, 6), 0)
    assert res.k == 3 and res.covariance_type == "full"
    pdf = _labels(res)
    post = np.stack(pdf["posterior"].to_numpy())
    assert np.allclose(post.sum(1), 1.0)
    assert (post.argmax(1) == pdf["cluster"].to_numpy()).all()  # argmax, first on ties
    assert brute_ari(y, pdf["cluster"].to_numpy()) == pytest.approx(1.0)
    assert res.silhouette > 0.5 and res.stability_ari > 0.7
    assert set(res.bic_curve) == set(res.icl_curve) == {2, 3, 4, 5}
    assert all(res.icl_curve[k] >= res.bic_curve[k] - 1e-9 for k in res.bic_curve)


def test_gmm_diagonal_below_50_rows(spark):
    x, _ = three_blobs(per_blob=12)
    res = C.fit_gmm(vec_frame(spark, x), len(x), 9, range(2, 4), 0)
    assert res.covariance_type == "diag"


def test_bic_golden_30_rows(spark):
    pm = prepare_matrix(spark.createDataFrame(golden30()), MUSIC)
    v = pm.vectors().cache()
    best = W.gmm_sweep(v, 30, 9, [2], 5, 0, "diag")
    ll, _ = W.gmm_scores(v, best)[2]
    assert W.bic(ll, best[2].n_params(), 30) == pytest.approx(87.6, abs=0.05)
    assert best[2].n_params() == 19 * 2 - 1


def test_kmeans_finds_three_blobs(blobs):
    x, y, v = blobs
    res = C.fit_kmeans(v, len(x), 9, range(2, 6), 0)
    assert res.k == 3
    ks = sorted(res.inertia_curve)
    inertia = [res.inertia_curve[k] for k in ks]
    assert all(a >= b - 1e-6 for a, b in zip(inertia, inertia[1:]))  # non-increasing in k
    assert brute_ari(y, _labels(res)["cluster"].to_numpy()) == pytest.approx(1.0)
    assert res.stability_ari > 0.7
    assert res.silhouette_curve[3] == max(res.silhouette_curve.values())


def test_k_range_errors(blobs):
    x, _, v = blobs
    with pytest.raises(ValueError, match="k_range max"):
        C.fit_kmeans(v, 5, 9, range(2, 8), 0)
    with pytest.raises(ValueError, match=">= 2"):
        C.fit_gmm(v, len(x), 9, [1], 0)


def _two_blobs_with_noise(seed=0, outliers=True):
    rng = np.random.default_rng(seed)
    a = rng.normal(0, 0.3, size=(40, 2))
    b = rng.normal(6, 0.3, size=(40, 2))
    parts = [a, b]
    if outliers:
        parts.append(np.array([[-9.0, 9.0], [-9.0, -9.0], [16.0, -6.0], [6.0, 18.0]]))
    return np.vstack(parts)


def brute_core(x, m):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    return np.sort(d, axis=1)[:, m - 1]  # the point itself counts as the first neighbour


def test_core_distance_and_mst_weight(spark):
    x = _two_blobs_with_noise()
    v = vec_frame(spark, x)
    core = H.core_distances(v, len(x), 5, block_rows=16).toPandas().sort_values("row_id")
    assert np.allclose(core["core"].to_numpy(), brute_core(x, 5))
    # Prim on the mutual-reachability graph
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    c = brute_core(x, 5)
    mr = np.maximum(d, np.maximum(c[:, None], c[None, :]))
    n = len(x)
    seen, best, total = np.zeros(n, bool), np.full(n, np.inf), 0.0
    best[0] = 0
    for _ in range(n):
        i = int(np.argmin(np.where(seen, np.inf, best)))
        total += best[i]
        seen[i] = True
        best = np.minimum(best, mr[i])
    index = build_index(v, n, 16)
    mst = H.boruvka_mst(index, indexed_knn(index, 5))
    assert mst.edges.count() == n - 1
    assert mst.edges.agg(F.sum("w")).first()[0] == pytest.approx(total)


def test_hdbscan_two_blobs_and_noise(spark):
    x = _two_blobs_with_noise()
    res = C.fit_hdbscan(vec_frame(spark, x), len(x), 2, 5, None)
    lab = _labels(res)["cluster"].to_numpy()
    assert res.k == 2
    assert (lab[-4:] == -1).all() and res.noise_rate > 0
    assert len(set(lab[:40])) == 1 and len(set(lab[40:80])) == 1 and lab[0] != lab[40]
    assert res.stability_ari == 1.0


def test_hdbscan_stricter_min_samples_more_noise(spark):
    x = _two_blobs_with_noise(1)
    v = vec_frame(spark, x)
    loose = C.fit_hdbscan(v, len(x), 2, 5, 2)
    strict = C.fit_hdbscan(v, len(x), 2, 5, 15)
    assert strict.noise_rate >= loose.noise_rate


def test_hdbscan_piles_of_equal_points(spark):
    from tessera.operators.density import fit_hdbscan

    x = np.repeat([[0.0], [1.0], [100.0]], 10, axis=0)
    labels, _ = fit_hdbscan(vec_frame(spark, x), 30, 5)
    by = {r["row_id"]: r["cluster"] for r in labels.collect()}
    assert len({by[i] for i in range(10)}) == len({by[i] for i in range(10, 20)}) == len({by[i] for i in range(20, 30)}) == 1
    assert sorted({by[0], by[10], by[20]}) == [0, 1, 2]


def test_seeds_come_from_all_rows(spark):
    """A group that stands only in the last rows of a long table gets a centre."""
    from tessera.operators import sweep as W

    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(0, 1, (13_000, 2)), rng.normal(0, 1, (13_000, 2)) + [30, 0], rng.normal(0, 1, (60, 2)) + [0, 60]])
    best = W.kmeans_sweep(vec_frame(spark, x), len(x), 2, [3], 2, 0, float(x.var(axis=0).mean()))
    assert min(np.abs(best[3].centers - [0, 60]).sum(axis=1)) < 1
    seeds = W.draw_seeds(vec_frame(spark, x), 3, 2, 0)
    assert all(abs(s.weights.sum() - len(x)) < 1e-3 and len(s.points) < 200 for s in seeds)


def test_empty_cluster_moves(spark):
    from tessera.operators import sweep as W

    x = np.array([[0.0], [0.1], [5.0], [5.1], [9.0], [9.1]])
    far = W.KMeansModel(k=3, centers=np.array([[0.0], [5.0], [1000.0]]))
    done = W.lloyd(vec_frame(spark, x), {0: far}, 1, 1e-9, 50)
    assert sorted(np.round(done[0].centers[:, 0], 2).tolist()) == [0.05, 5.05, 9.05]


def test_scan_of_many_partitions_is_summed_before_the_driver(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    rows, collect = [], DataFrame.collect

    def watched(self):
        got = collect(self)
        rows.append(len(got))
        return got

    v = vec_frame(spark, np.random.default_rng(1).normal(size=(400, 64))).repartition(64, "row_id")
    monkeypatch.setattr(DataFrame, "collect", watched)
    centers = {m: np.eye(64)[:10] * (m + 1) for m in range(10)}
    stats = W._run_scan(v, W._lloyd_fn(centers), 10 * (10 * 66 + 1))
    assert rows == [10 * 11]  # a row for each model and component, however many partitions
    assert sum(stats[(0, j)][0] for j in range(10) if (0, j) in stats) == 400

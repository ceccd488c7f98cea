"""The flagship queries run the whole end-to-end call."""

import inspect

import numpy as np
import pytest

from tessera.operators import pairs, sweep
from tessera.plans import flagship
from tessera.plans.registry import all_queries
from tessera.spec import DEFAULT_K_RANGE


@pytest.mark.parametrize("name", ["gmm_fit", "cluster_tracks", "cluster_descriptions"])
def test_fit_queries_narrow_nothing(spark, monkeypatch, name):
    class Seen(Exception):
        pass

    def watched(*args, **kw):
        call = inspect.signature(cluster).bind(*args, **kw)
        call.apply_defaults()
        raise Seen(call.arguments)

    cluster = flagship.cluster
    monkeypatch.setattr(flagship, "cluster", watched)
    with pytest.raises(Seen) as seen:
        all_queries()[name](spark, "/root/testdata/sf0.001")
    given = seen.value.args[0]
    assert tuple(given["k_range"]) == DEFAULT_K_RANGE
    assert given["diagnostics"] and given["layout"]


@pytest.mark.parametrize("cov_type", ["full", "diag"])
def test_em_sums_of_all_models_at_once_equal_each_by_itself(monkeypatch, cov_type):
    r = np.random.default_rng(5)
    x = r.normal(size=(2500, 3))
    models = {}
    for m, k in enumerate((2, 5, 3)):
        covs = np.stack([np.cov(r.normal(size=(3, 20))) * r.choice([0.01, 1.0]) for _ in range(k)])
        covs = np.stack([np.diag(c) for c in covs]) if cov_type == "diag" else covs
        models[m] = sweep.Gmm(k=k, weights=np.full(k, 1 / k), means=r.normal(size=(k, 3)), covs=covs, cov_type=cov_type)
    one_by_one, calls = sweep.posteriors, []
    monkeypatch.setattr(sweep, "posteriors", lambda *a: calls.append(a) or one_by_one(*a))
    fast = list(sweep._em_stats_fn(models)(x))
    assert not calls
    monkeypatch.setattr(sweep, "EM_ERROR", -1.0)  # as for components too narrow to be written out
    slow = list(sweep._em_stats_fn(models)(x))
    assert len(calls) == len(models) and [f[:2] for f in fast] == [s[:2] for s in slow]
    assert all(np.allclose(f[2], s[2], rtol=1e-9, atol=1e-9) for f, s in zip(fast, slow))


def test_silhouette_sums_take_a_column_for_each_combination_of_labels():
    r = np.random.default_rng(6)
    x, y = r.normal(size=(700, 4)), r.normal(size=(500, 4))
    labels = [np.digitize(z[:, 0], [-1, 0, 1]) for z in (x, y)]
    # eleven labelings that agree: 44 labels, four combinations
    hx, hy = (np.tile(np.eye(4)[v], 11) for v in labels)
    d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(-1))
    left, right = pairs._label_sums(x, y, hx, hy, False)
    assert np.allclose(left, d @ hy, rtol=1e-11) and np.allclose(right, d.T @ hx, rtol=1e-11)
    order, group, rows = pairs._grouped(hy)
    assert (hy[order] == rows[group]).all()
    assert max(columns.shape[1] for columns, _ in pairs._tile_columns(group, rows, hy[order], pairs.TILE)) <= 4

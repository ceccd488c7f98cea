"""Batched model sweeps: Gaussian mixtures (EM) and K-means (Lloyd).

Every (k, init) model of a sweep advances in the *same* scan: one
``mapInArrow`` pass over the cached matrix computes, per partition and per
model, the sufficient statistics of the E-step (or the assignment step), and
a native aggregate adds them up (the shuffle is partitions x models x stats,
independent of the row count).
The driver then performs the tiny M-step on k x d x d numbers and ships the
next parameters with the next scan. Converged models drop out of the scan.

Initialisation follows the library defaults the original tool relies on:
GMM starts from a one-init K-means partition; K-means from k-means++
seeds. Seeds come from the whole matrix by k-means||: a few rounds draw rows
in proportion to their squared distance from what is drawn already, and only
these (some multiples of k, however many rows there are) reach the driver,
with the number of rows nearest to each as weights.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.spec import EM_MAX_ITER, EM_REG_COVAR, EM_TOL, KMEANS_MAX_ITER, KMEANS_TOL

#: k-means||: rounds, and rows drawn in a round per centre sought.
SEED_ROUNDS = 3
SEED_DRAWS = 4
_EPS10 = 10 * np.finfo(np.float64).eps
_LOG2PI = math.log(2 * math.pi)


# ---------------------------------------------------------------------------
# parameters
# ---------------------------------------------------------------------------

@dataclass
class Gmm:
    k: int
    weights: np.ndarray  # (k,)
    means: np.ndarray  # (k, d)
    covs: np.ndarray  # (k, d, d) full or (k, d) diag
    cov_type: str
    lower_bound: float = -np.inf
    n_iter: int = 0
    converged: bool = False
    _chol: np.ndarray | None = field(default=None, repr=False)

    def log_prob(self, x: np.ndarray) -> np.ndarray:
        """(n, k) of log(weight_c) + log N(x | mean_c, cov_c)."""
        n, d = x.shape
        out = np.empty((n, self.k))
        if self.cov_type == "diag":
            prec = 1.0 / self.covs
            for c in range(self.k):
                diff = x - self.means[c]
                out[:, c] = -0.5 * (d * _LOG2PI + np.log(self.covs[c]).sum() + (diff * diff * prec[c]).sum(axis=1))
        else:
            if self._chol is None:
                self._chol = np.linalg.cholesky(self.covs)
            for c in range(self.k):
                L = self._chol[c]
                z = np.linalg.solve(L, (x - self.means[c]).T)  # (d, n)
                logdet = 2.0 * np.log(np.diag(L)).sum()
                out[:, c] = -0.5 * (d * _LOG2PI + logdet + (z * z).sum(axis=0))
        return out + np.log(self.weights)

    def n_params(self) -> int:
        d = self.means.shape[1]
        cov = self.k * d * (d + 1) / 2 if self.cov_type == "full" else self.k * d
        return int(cov + self.k * d + self.k - 1)


def posteriors(model: Gmm, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row log-likelihoods and posterior matrix (rows sum to 1)."""
    lp = model.log_prob(x)
    mx = lp.max(axis=1, keepdims=True)
    ll = mx[:, 0] + np.log(np.exp(lp - mx).sum(axis=1))
    return ll, np.exp(lp - ll[:, None])


def m_step(nk: np.ndarray, s1: np.ndarray, s2: np.ndarray, n: float, cov_type: str, reg: float = EM_REG_COVAR):
    """Weights, means, covariances from summed responsibilities (library formulas)."""
    nk = nk + _EPS10
    means = s1 / nk[:, None]
    if cov_type == "diag":
        covs = s2 / nk[:, None] - means * means + reg
        covs = np.maximum(covs, reg)
    else:
        covs = s2 / nk[:, None, None] - np.einsum("ki,kj->kij", means, means)
        covs = 0.5 * (covs + np.transpose(covs, (0, 2, 1)))
        covs = covs + reg * np.eye(means.shape[1])[None]
    return nk / n, means, covs


# ---------------------------------------------------------------------------
# one distributed scan
# ---------------------------------------------------------------------------

STATS_SCHEMA = "model int, comp int, s array<double>"


def x_of_batch(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    """The ``array<double>`` column of an Arrow batch as an (n, d) matrix, zero-copy."""
    col = batch.column(batch.schema.get_field_index(name))
    n = len(col)
    if n == 0:
        return np.empty((0, 0))
    vals = col.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(vals, dtype=np.float64).reshape(n, -1)


def list_column(m: np.ndarray) -> pa.ListArray:
    """An (n, k) matrix as an Arrow ``list<double>`` column (one list per row)."""
    n, k = m.shape
    offsets = pa.array(np.arange(0, n * k + 1, k, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(m, dtype=np.float64).ravel()))


#: Collect per-partition partial statistics straight to the driver while
#: partitions x statistic width stays below this many doubles (half a MB; a fit
#: has hundreds of scans); above it the partials are summed by a native aggregate
#: on the executors first, so that what the driver gets depends on the models alone.
DIRECT_COLLECT_DOUBLES = 65_536


def _per_partition(batch_fn):
    """Wrap a per-batch statistics function so each partition yields one summed set."""

    def run(it):
        acc: dict[tuple[int, int], np.ndarray] = {}
        for batch in it:
            if batch.num_rows == 0:
                continue
            for mid, comp, vec in batch_fn(x_of_batch(batch)):
                key = (mid, comp)
                v = np.asarray(vec, dtype=np.float64)
                acc[key] = acc[key] + v if key in acc else v
        if acc:
            vals = list(acc.values())
            lens = np.array([0] + [len(v) for v in vals], dtype=np.int32)
            s = pa.ListArray.from_arrays(pa.array(np.cumsum(lens, dtype=np.int32)), pa.array(np.concatenate(vals)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in acc], pa.int32()), pa.array([k[1] for k in acc], pa.int32()), s],
                names=["model", "comp", "s"],
            )

    return run


def _run_scan(vecs: DataFrame, batch_fn, width: int | None = None) -> dict[tuple[int, int], np.ndarray]:
    """Sum a per-batch statistic over the whole frame, keyed by (model, comp)."""
    out = vecs.select("x").mapInArrow(_per_partition(batch_fn), STATS_SCHEMA)
    parts = vecs.rdd.getNumPartitions()
    if width is not None and parts * width <= DIRECT_COLLECT_DOUBLES:
        acc: dict[tuple[int, int], np.ndarray] = {}
        for r in out.collect():
            key = (r["model"], r["comp"])
            v = np.asarray(r["s"], dtype=np.float64)
            acc[key] = acc[key] + v if key in acc else v
        return acc
    # plain sums, place by place (a Summarizer's sum is a mean times a weight, so counts would not be whole)
    places = out.repartition("model", "comp").select("model", "comp", F.posexplode("s").alias("j", "v"))
    sums = places.groupBy("model", "comp", "j").agg(F.sum("v").alias("v"))
    listed = F.array_sort(F.collect_list(F.struct("j", "v")))
    agg = sums.groupBy("model", "comp").agg(F.transform(listed, lambda e: e["v"]).alias("s"))
    return {(r["model"], r["comp"]): np.array(r["s"]) for r in agg.collect()}


#: Rows of a batch whose log-probabilities are made at once; all models' fit into the cache.
EM_ROWS = 1024
#: Error of an expanded log-probability above which a batch goes through ``posteriors``.
EM_ERROR = 1e-9


class _Expanded:
    """Log-probabilities of all models as one product: a row's features (1, x, products of x) by coefficients.

    ``(x - m)' P (x - m)`` is written out, which costs digits where a component is narrow and
    far from 0; ``error`` bounds that for a batch.
    """

    def __init__(self, models: dict[int, Gmm]):
        self.models = models
        self.ks = [m.k for m in models.values()]
        self.starts = np.concatenate([[0], np.cumsum(self.ks)[:-1]])
        first = next(iter(models.values()))
        self.diag, self.d = first.cov_type == "diag", first.means.shape[1]
        self.at = (np.arange(self.d),) * 2 if self.diag else np.triu_indices(self.d)
        parts, self.sharpest, self.reach = [], 0.0, 0.0
        for m in models.values():
            if self.diag:
                prec, logdet = np.stack([np.diag(1.0 / c) for c in m.covs]), np.log(m.covs).sum(axis=1)
            else:
                chol = np.linalg.cholesky(m.covs)
                inv = np.linalg.inv(chol)
                prec, logdet = np.swapaxes(inv, 1, 2) @ inv, 2.0 * np.log(np.diagonal(chol, axis1=1, axis2=2)).sum(axis=1)
            pull = np.einsum("kij,kj->ki", prec, m.means)
            const = np.log(m.weights) - 0.5 * (self.d * _LOG2PI + logdet + (pull * m.means).sum(axis=1))
            square = -prec[:, self.at[0], self.at[1]] * np.where(self.at[0] == self.at[1], 0.5, 1.0)
            parts.append(np.column_stack([const, pull, square]))
            self.sharpest = max(self.sharpest, float(np.abs(prec).sum(axis=2).max()))
            self.reach = max(self.reach, float((m.means * m.means).sum(axis=1).max()))
        self.coef = np.concatenate(parts)

    def error(self, x: np.ndarray) -> float:
        reach = max(self.reach, float((x * x).sum(axis=1).max()))
        return 4.0 * np.finfo(np.float64).eps * self.sharpest * reach

    def stats(self, x: np.ndarray):
        """(log-likelihood of each model, per component the sums of its responsibilities times the features)."""
        ll, sums = np.zeros(len(self.ks)), np.zeros_like(self.coef)
        for s in range(0, len(x), EM_ROWS):
            part = x[s:s + EM_ROWS]
            feats = np.column_stack([np.ones(len(part)), part, part[:, self.at[0]] * part[:, self.at[1]]])
            p = self.coef @ feats.T
            top = np.maximum.reduceat(p, self.starts, axis=0)
            p -= np.repeat(top, self.ks, axis=0)
            np.exp(p, out=p)
            total = np.add.reduceat(p, self.starts, axis=0)
            p /= np.repeat(total, self.ks, axis=0)
            ll += (top + np.log(total)).sum(axis=1)
            sums += p @ feats
        return ll, sums

    def unpacked(self, row: np.ndarray) -> np.ndarray:
        """[N, S1, S2] of a component, S2 as a whole matrix where covariances are full."""
        if self.diag:
            return row
        s2 = np.empty((self.d, self.d))
        s2[self.at], s2[self.at[1], self.at[0]] = row[1 + self.d:], row[1 + self.d:]
        return np.concatenate([row[:1 + self.d], s2.ravel()])


def _em_stats_fn(models: dict[int, Gmm], hard_centers: dict[int, np.ndarray] | None = None):
    """E-step statistics per model: comp c -> [N_c, S1_c, S2_c]; comp -1 -> [loglik, rows]."""
    expanded = _Expanded(models) if hard_centers is None else None

    def stats(x):
        if expanded is not None and expanded.error(x) <= EM_ERROR:
            ll, sums = expanded.stats(x)
            for i, (mid, m) in enumerate(models.items()):
                for c in range(m.k):
                    yield mid, c, expanded.unpacked(sums[expanded.starts[i] + c])
                yield mid, -1, np.array([float(ll[i]), float(len(x))])
            return
        for mid, m in models.items():
            if hard_centers is not None:
                c = hard_centers[mid]
                d2 = ((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
                resp = np.zeros((len(x), len(c)))
                resp[np.arange(len(x)), d2.argmin(axis=1)] = 1.0
                ll = np.zeros(len(x))
                cov_type = m
            else:
                ll, resp = posteriors(m, x)
                cov_type = m.cov_type
            nk = resp.sum(axis=0)
            s1 = resp.T @ x
            if cov_type == "diag":
                s2 = resp.T @ (x * x)
            else:
                s2 = np.stack([(resp[:, c, None] * x).T @ x for c in range(resp.shape[1])]).reshape(resp.shape[1], -1)
            for c in range(resp.shape[1]):
                yield mid, c, np.concatenate([[nk[c]], s1[c], s2[c]])
            yield mid, -1, np.array([float(ll.sum()), float(len(x))])

    return stats


def _em_width(ks: list[int], n_init: int, d: int, cov_type: str) -> int:
    per = 1 + d + (d if cov_type == "diag" else d * d)
    return n_init * sum(k * per + 2 for k in ks)


def _unpack(stats, mid: int, k: int, d: int, cov_type: str):
    nk = np.zeros(k)
    s1 = np.zeros((k, d))
    s2 = np.zeros((k, d) if cov_type == "diag" else (k, d, d))
    for c in range(k):
        v = stats.get((mid, c))
        if v is None:
            continue
        nk[c] = v[0]
        s1[c] = v[1:1 + d]
        s2[c] = v[1 + d:].reshape(s2.shape[1:])
    ll, rows = stats.get((mid, -1), (0.0, 0.0))
    return nk, s1, s2, ll, rows


# ---------------------------------------------------------------------------
# seeding from all rows (k-means||)
# ---------------------------------------------------------------------------

@dataclass
class Seeds:
    """Rows drawn for one init, and how many rows of the matrix lie nearest to each."""

    points: np.ndarray
    weights: np.ndarray


def _sq_dists(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)[None, :], 0.0)


def _hash01(row_id: np.ndarray, *salt: int) -> np.ndarray:
    """Uniform numbers in [0, 1) that depend on the row id and the salt alone."""
    h = row_id.astype(np.uint64)
    with np.errstate(over="ignore"):
        for s in salt:
            h = (h + np.uint64(s + 1)) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(31)
    return (h >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def draw_seeds(vecs: DataFrame, k_max: int, n_init: int, seed: int) -> list[Seeds]:
    """Candidate centres of every init, from scans of the whole matrix."""
    d_of = vecs.select("row_id", "x")
    firsts = d_of.agg(*[F.min_by("x", F.struct(F.xxhash64(F.col("row_id"), F.lit(seed), F.lit(i)), "row_id")).alias(f"c{i}") for i in range(n_init)]).first()
    drawn = {i: np.array([firsts[i]], dtype=np.float64) for i in range(n_init)}
    want = float(SEED_DRAWS * k_max)
    for r in range(SEED_ROUNDS):
        def spread(x, now=dict(drawn)):
            for i, c in now.items():
                yield i, 0, np.array([_sq_dists(x, c).min(axis=1).sum()])

        total = {i: float(v[0]) for (i, _), v in _run_scan(vecs, spread, n_init).items()}

        def pick(it, now=dict(drawn), total=total, r=r):
            for batch in it:
                if batch.num_rows == 0:
                    continue
                x, ids = x_of_batch(batch), batch.column("row_id").to_numpy(zero_copy_only=False)
                for i, c in now.items():
                    if total.get(i, 0.0) <= 0:
                        continue
                    share = want * _sq_dists(x, c).min(axis=1) / total[i]
                    at = np.flatnonzero(_hash01(ids, seed, i, r) < share)
                    if len(at):
                        rows = pa.array([x[a].tolist() for a in at], pa.list_(pa.float64()))
                        yield pa.RecordBatch.from_arrays([pa.array([i] * len(at), pa.int32()), pa.array(ids[at], pa.int64()), rows], names=["i", "row_id", "x"])

        new = d_of.mapInArrow(pick, "i int, row_id long, x array<double>").collect()
        for i in range(n_init):
            rows = [q["x"] for q in sorted((q for q in new if q["i"] == i), key=lambda q: q["row_id"])]
            if rows:
                drawn[i] = np.vstack([drawn[i], np.array(rows, dtype=np.float64)])

    def nearest(x):
        for i, c in drawn.items():
            yield i, 0, np.bincount(_sq_dists(x, c).argmin(axis=1), minlength=len(c)).astype(np.float64)

    weights = _run_scan(vecs, nearest, sum(map(len, drawn.values())))
    return [Seeds(drawn[i], np.maximum(weights[(i, 0)], 1e-9)) for i in range(n_init)]


def kmeanspp(seeds: Seeds, k: int, rng: np.random.Generator) -> np.ndarray:
    """Greedy k-means++ on weighted points (2 + log k trials per centre)."""
    x, w = seeds.points, seeds.weights
    trials = 2 + int(np.log(k))
    first = int(rng.choice(len(x), p=w / w.sum()))
    chosen, d2 = [first], _sq_dists(x, x[[first]])[:, 0]
    while len(chosen) < k:
        mass = d2 * w
        if mass.sum() <= 0:  # fewer distinct points than centres
            chosen.append(int(rng.integers(len(x))))
            continue
        trial = rng.choice(len(x), size=trials, p=mass / mass.sum())
        after = np.minimum(d2[:, None], _sq_dists(x, x[trial]))
        best = int((after * w[:, None]).sum(axis=0).argmin())
        chosen.append(int(trial[best]))
        d2 = after[:, best]
    return x[chosen].copy()


# ---------------------------------------------------------------------------
# K-means (batched Lloyd)
# ---------------------------------------------------------------------------

@dataclass
class KMeansModel:
    k: int
    centers: np.ndarray
    inertia: float = np.inf
    n_iter: int = 0
    converged: bool = False
    # quality of the final nearest-centre labels, from the same scan
    label_counts: np.ndarray | None = None
    label_means: np.ndarray | None = None
    within: float = 0.0  # sum of squared distances to the label means
    between: float = 0.0  # sum_k n_k |mean_k - overall mean|^2

    def calinski_harabasz(self) -> float:
        n = float(self.label_counts.sum())
        k = int((self.label_counts > 0).sum())
        if k < 2 or n <= k:
            return 0.0
        if self.within == 0:
            return 1.0
        return (self.between / (k - 1)) / (self.within / (n - k))


def _label_quality(km: KMeansModel, stats, m: int, d: int) -> None:
    cnt = np.zeros(km.k)
    sums = np.zeros((km.k, d))
    sq = np.zeros(km.k)
    for j in range(km.k):
        v = stats.get((m, j))
        if v is not None:
            cnt[j], sums[j], sq[j] = v[0], v[1:1 + d], v[1 + d]
    safe = np.maximum(cnt, 1.0)
    means = sums / safe[:, None]
    km.label_counts, km.label_means = cnt, means
    km.within = float(max(0.0, (sq - (sums * sums).sum(axis=1) / safe).sum()))
    g = sums.sum(axis=0) / max(cnt.sum(), 1.0)
    km.between = float((cnt * ((means - g) ** 2).sum(axis=1)).sum())


def _lloyd_fn(models: dict[int, np.ndarray]):
    """Assignment statistics: comp c -> [count, sum x, sum |x|^2]; comp -1 -> [inertia]."""

    def stats(x):
        xx = (x * x).sum(axis=1)
        for mid, c in models.items():
            d2 = np.maximum(xx[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)[None, :], 0.0)
            lab = d2.argmin(axis=1)
            k = len(c)
            onehot = np.zeros((len(x), k))
            onehot[np.arange(len(x)), lab] = 1.0
            cnt = onehot.sum(axis=0)
            sums = onehot.T @ x
            sq = onehot.T @ xx
            for j in range(k):
                yield mid, j, np.concatenate([[cnt[j]], sums[j], [sq[j]]])
            yield mid, -1, np.array([float(d2[np.arange(len(x)), lab].sum())])

    return stats


def _farthest(vecs: DataFrame, centers: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` rows farthest from their nearest centre; each task hands on as many."""

    def run(it):
        for batch in it:
            if batch.num_rows == 0:
                continue
            x = x_of_batch(batch)
            far = _sq_dists(x, centers).min(axis=1)
            at = np.argsort(-far, kind="stable")[:count]
            yield pa.RecordBatch.from_arrays([pa.array(far[at]), pa.array([x[a].tolist() for a in at], pa.list_(pa.float64()))], names=["far", "x"])

    top = vecs.select("x").mapInArrow(run, "far double, x array<double>").orderBy(F.col("far").desc(), "x").limit(count)
    return np.array([r["x"] for r in top.collect()], dtype=np.float64)


def lloyd(vecs: DataFrame, models: dict[int, KMeansModel], d: int, tol: float, max_iter: int) -> dict[int, KMeansModel]:
    """Lloyd iterations of all models over the whole matrix; converged ones leave the scan.

    A centre that loses all its rows moves to the row farthest from its centre.
    """
    live, done = dict(models), {}
    width = sum(km.k * (2 + d) + 1 for km in live.values())
    for it in range(max_iter):
        if not live:
            break
        stats = _run_scan(vecs, _lloyd_fn({m: km.centers for m, km in live.items()}), width)
        for m in list(live):
            km = live[m]
            rows = {j: v for j in range(km.k) if (v := stats.get((m, j))) is not None and v[0] > 0}
            new = km.centers.copy()
            for j, v in rows.items():
                new[j] = v[1:1 + d] / v[0]
            empty = [j for j in range(km.k) if j not in rows]
            if empty:
                far = _farthest(vecs, km.centers, len(empty))
                new[empty[:len(far)]] = far
            km.inertia = float(stats.get((m, -1), [np.inf])[0])
            shift = float(((new - km.centers) ** 2).sum())
            km.centers, km.n_iter = new, it + 1
            if shift <= tol:
                km.converged = True
                done[m] = live.pop(m)
    return {**done, **live}


def kmeans_sweep(
    vecs: DataFrame,
    n: int,
    d: int,
    ks: list[int],
    n_init: int,
    seed: int,
    feature_var_mean: float,
    max_iter: int = KMEANS_MAX_ITER,
) -> dict[int, KMeansModel]:
    """Best-of-``n_init`` K-means for every k, all models in each scan."""
    seeds = draw_seeds(vecs, max(ks), n_init, seed)
    live: dict[int, KMeansModel] = {}
    key: dict[int, tuple[int, int]] = {}
    mid = 0
    for k in ks:
        for i in range(n_init):
            rng = np.random.default_rng([seed, k, i])
            live[mid] = KMeansModel(k=k, centers=kmeanspp(seeds[i], k, rng))
            key[mid] = (k, i)
            mid += 1
    width = n_init * sum(k * (2 + d) + 1 for k in ks)
    done = lloyd(vecs, live, d, KMEANS_TOL * feature_var_mean, max_iter)
    # final inertia with the final centres (one more batched scan)
    stats = _run_scan(vecs, _lloyd_fn({m: km.centers for m, km in done.items()}), width)
    best: dict[int, KMeansModel] = {}
    for m, km in done.items():
        km.inertia = float(stats[(m, -1)][0])
        _label_quality(km, stats, m, d)
        k = key[m][0]
        if k not in best or km.inertia < best[k].inertia:
            best[k] = km
    return best


def kmeans_labels(vecs: DataFrame, centers: np.ndarray) -> DataFrame:
    """``(row_id, cluster)`` = nearest centre (first on ties)."""
    c = np.asarray(centers)

    def run(it):
        for batch in it:
            if batch.num_rows == 0:
                continue
            x = x_of_batch(batch)
            d2 = (x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)[None, :]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(d2.argmin(axis=1).astype(np.int32))], names=["row_id", "cluster"]
            )

    return vecs.select("row_id", "x").mapInArrow(run, "row_id long, cluster int")


# ---------------------------------------------------------------------------
# Gaussian mixtures (batched EM)
# ---------------------------------------------------------------------------

def gmm_sweep(
    vecs: DataFrame,
    n: int,
    d: int,
    ks: list[int],
    n_init: int,
    seed: int,
    cov_type: str,
    tol: float = EM_TOL,
    max_iter: int = EM_MAX_ITER,
) -> dict[int, Gmm]:
    """Best-of-``n_init`` mixture for every k (highest final lower bound)."""
    # 1. seeds -> K-means over all rows to its end -> hard partition
    seeds = draw_seeds(vecs, max(ks), n_init, seed)
    moments = _run_scan(vecs, lambda x: [(0, 0, np.concatenate([x.sum(axis=0), (x * x).sum(axis=0)]))], 2 * d)[(0, 0)] / n
    var = float(np.maximum(moments[d:] - moments[:d] ** 2, 0.0).mean())
    start: dict[int, KMeansModel] = {}
    key: dict[int, tuple[int, int]] = {}
    mid = 0
    for k in ks:
        for i in range(n_init):
            rng = np.random.default_rng([seed, k, i, 7])
            start[mid] = KMeansModel(k=k, centers=kmeanspp(seeds[i], k, rng))
            key[mid] = (k, i)
            mid += 1
    inits = {m: km.centers for m, km in lloyd(vecs, start, d, KMEANS_TOL * var, KMEANS_MAX_ITER).items()}
    width = _em_width(ks, n_init, d, cov_type)
    stats = _run_scan(vecs, _em_stats_fn({m: cov_type for m in inits}, hard_centers=inits), width)
    live: dict[int, Gmm] = {}
    for m, c in inits.items():
        k = key[m][0]
        nk, s1, s2, _, rows = _unpack(stats, m, k, d, cov_type)
        w, mu, cov = m_step(nk, s1, s2, n, cov_type)
        live[m] = Gmm(k=k, weights=w, means=mu, covs=cov, cov_type=cov_type)
    # 2. EM iterations, converged models leave the scan
    done: dict[int, Gmm] = {}
    for it in range(max_iter):
        if not live:
            break
        stats = _run_scan(vecs, _em_stats_fn(dict(live)), width)
        for m in list(live):
            g = live[m]
            nk, s1, s2, ll, rows = _unpack(stats, m, g.k, d, cov_type)
            prev = g.lower_bound
            w, mu, cov = m_step(nk, s1, s2, n, cov_type)
            g.weights, g.means, g.covs, g._chol = w, mu, cov, None
            g.lower_bound = ll / n
            g.n_iter = it + 1
            if abs(g.lower_bound - prev) < tol:
                g.converged = True
                done[m] = live.pop(m)
    done.update(live)
    best: dict[int, Gmm] = {}
    for m, g in done.items():
        k = key[m][0]
        if k not in best or g.lower_bound > best[k].lower_bound:
            best[k] = g
    return best


SCORE_SCHEMA = "model int, ll double, ent double"


def gmm_scores(vecs: DataFrame, models: dict[int, Gmm]) -> dict[int, tuple[float, float]]:
    """Total log-likelihood and sum p*ln(clip p) per model, one batched scan."""
    from tessera.spec import POSTERIOR_LOG_FLOOR

    def run(it):
        for batch in it:
            if batch.num_rows == 0:
                continue
            x = x_of_batch(batch)
            rows = []
            for mid, g in models.items():
                ll, p = posteriors(g, x)
                ent = float((p * np.log(np.clip(p, POSTERIOR_LOG_FLOOR, 1.0))).sum())
                rows.append((mid, float(ll.sum()), ent))
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["model", "ll", "ent"]).astype({"model": "int32"}),
                                             preserve_index=False)

    agg = vecs.select("x").mapInArrow(run, SCORE_SCHEMA).groupBy("model").agg(
        F.sum("ll").alias("ll"), F.sum("ent").alias("ent")
    )
    return {r["model"]: (r["ll"], r["ent"]) for r in agg.collect()}


def gmm_assign(vecs: DataFrame, g: Gmm) -> DataFrame:
    """``(row_id, cluster, posterior array<double>)``; label = argmax, first on ties."""

    def run(it):
        for batch in it:
            if batch.num_rows == 0:
                continue
            _, p = posteriors(g, x_of_batch(batch))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p.argmax(axis=1).astype(np.int32)), list_column(p)],
                names=["row_id", "cluster", "posterior"],
            )

    return vecs.select("row_id", "x").mapInArrow(run, "row_id long, cluster int, posterior array<double>")


def bic(total_ll: float, n_params: int, n: int) -> float:
    """C4: -2 log L + p ln n."""
    return -2.0 * total_ll + n_params * math.log(n)


def icl(bic_value: float, entropy_sum: float) -> float:
    """BIC - 2 * sum p ln(clip p)."""
    return bic_value - 2.0 * entropy_sum

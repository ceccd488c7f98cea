"""Cluster quality from labels: sizes, centroids, inertia, cohesion, CH, silhouette, ARI.

Input everywhere is ``(row_id, cluster, x array<double>)``. Centroids are a
k x d table (small, size checked before it is broadcast); everything per row
is a projection over the broadcast centroids, so the only shuffles are the
partial aggregates of width k*d.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.pairs import cluster_distance_sums, multi_distance_sums, silhouette_blocks

#: Largest centroid table (k * d values) that is broadcast to the rows.
MAX_BROADCAST_CELLS = 5_000_000


def _checked_broadcast(small: DataFrame, cells: int) -> DataFrame:
    if cells <= MAX_BROADCAST_CELLS:
        return F.broadcast(small)
    return small  # let the planner shuffle-join a table too large to ship


def clustered(vecs: DataFrame) -> DataFrame:
    """Rows with a real cluster id (noise ``-1`` excluded)."""
    return vecs.where(F.col("cluster") >= 0)


def cluster_sizes(labels: DataFrame) -> DataFrame:
    """``(cluster, size)`` for every id present, noise included."""
    return labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))


def centroids_long(vecs: DataFrame) -> DataFrame:
    """``(cluster, j, mean)`` per real cluster and dimension."""
    long = clustered(vecs).select("cluster", F.posexplode("x").alias("j", "v"))
    return long.groupBy("cluster", "j").agg(F.avg("v").alias("mean"))


def centroids(vecs: DataFrame) -> DataFrame:
    """``(cluster, size, c array<double>)`` -- one row per real cluster."""
    long = centroids_long(vecs)
    arr = long.groupBy("cluster").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("j", "mean"))), lambda s: s["mean"]).alias("c")
    )
    return arr.join(cluster_sizes(clustered(vecs)), "cluster")


def sq_dist(x: Column, c: Column) -> Column:
    """Squared Euclidean distance of two equal-length arrays, JVM-side."""
    return F.aggregate(F.zip_with(x, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, t: acc + t)


def one_row(*frames: DataFrame) -> DataFrame:
    """Combine single-row aggregates with disjoint columns into one row (no join)."""
    u = frames[0]
    for f in frames[1:]:
        u = u.unionByName(f, allowMissingColumns=True)
    return u.agg(*[F.first(c, ignorenulls=True).alias(c) for c in u.columns])


def centroid_table(vecs: DataFrame, d: int) -> tuple[DataFrame, int]:
    """Centroids cached, plus k; broadcast-ready when k*d is within the limit."""
    cents = centroids(vecs).cache()
    k = cents.count()
    return cents, k


def _join_centroids(vecs: DataFrame, cents: DataFrame, k: int, d: int) -> DataFrame:
    return clustered(vecs).join(_checked_broadcast(cents.select("cluster", "c"), k * d), "cluster")


def within_ss(vecs: DataFrame, cents: DataFrame, k: int, d: int) -> DataFrame:
    """One row: ``w`` = sum of squared distances to own centroid, ``n`` rows."""
    rows = _join_centroids(vecs, cents, k, d)
    return rows.agg(F.sum(sq_dist(F.col("x"), F.col("c"))).alias("w"), F.count(F.lit(1)).alias("n"))


def between_ss(vecs: DataFrame) -> DataFrame:
    """One row: ``b`` = sum_k n_k |c_k - g|^2 and ``k``, from the centroid table alone.

    Uses sum_k n_k |c_k|^2 - |sum_k n_k c_k|^2 / n, per dimension.
    """
    long = centroids_long(vecs).join(cluster_sizes(clustered(vecs)), "cluster")
    per_j = long.groupBy("j").agg(
        F.sum(F.col("size") * F.col("mean") * F.col("mean")).alias("t1"),
        F.sum(F.col("size") * F.col("mean")).alias("sj"),
        F.sum("size").alias("nj"),
        F.count(F.lit(1)).alias("kj"),
    )
    return per_j.agg(
        F.sum(F.col("t1") - F.col("sj") * F.col("sj") / F.col("nj")).alias("b"),
        F.max("kj").alias("k"),
    )


def quality_scalars(vecs: DataFrame, d: int) -> dict:
    """Inertia (C8), cohesion (C14) and Calinski-Harabasz (C10), clustered rows only."""
    cents, k = centroid_table(vecs, d)
    r = one_row(within_ss(vecs, cents, k, d), between_ss(vecs)).first()
    cents.unpersist()
    w, n = float(r["w"] or 0.0), int(r["n"] or 0)
    out = {"inertia": w, "n": n, "k": k, "cohesion": (w / n) if n else 0.0, "ch": None}
    if k >= 2 and n > k:
        b = float(r["b"])
        out["ch"] = 1.0 if w == 0 else (b / (k - 1)) / (w / (n - k))
    return out


def inertia_frame(vecs: DataFrame, d: int) -> DataFrame:
    """One row ``inertia`` = sum of squared distances to own centroid."""
    cents, k = centroid_table(vecs, d)
    return within_ss(vecs, cents, k, d).select(F.col("w").alias("inertia"))


def cohesion_frame(vecs: DataFrame, d: int) -> DataFrame:
    """C14: one row ``cohesion`` = inertia / clustered rows (0.0 when none)."""
    cents, k = centroid_table(vecs, d)
    return within_ss(vecs, cents, k, d).select(
        F.coalesce(F.col("w") / F.col("n"), F.lit(0.0)).alias("cohesion")
    )


def ch_frame(vecs: DataFrame, d: int) -> DataFrame:
    """Calinski-Harabasz index as one row, computed in the plan."""
    cents, k = centroid_table(vecs, d)
    t = one_row(within_ss(vecs, cents, k, d), between_ss(vecs))
    return t.select(
        F.when(F.col("w") == 0, F.lit(1.0))
        .otherwise((F.col("b") / (F.col("k") - 1)) / (F.col("w") / (F.col("n") - F.col("k"))))
        .alias("ch_index")
    )


def silhouette_rows(vecs: DataFrame, n: int | None = None, block_rows: int | None = None) -> DataFrame:
    """Exact silhouette of every clustered row, ``(row_id, cluster, s)``.

    a = mean distance to the other members of its cluster, b = the smallest
    mean distance to another cluster; s = (b - a) / max(a, b); a singleton
    cluster scores 0.
    """
    cl = clustered(vecs)
    if n is None:
        n = cl.count()
    first = cl.select(F.size("x").alias("d")).first()
    blocks = silhouette_blocks(n, int(first["d"]) if first else 1, vecs.sparkSession.sparkContext.defaultParallelism, block_rows)
    sums = cluster_distance_sums(cl, n, blocks)
    per_row = sums.groupBy("row_id", "own").agg(
        F.max(F.when(F.col("other") == F.col("own"), F.col("mean_dist"))).alias("a"),
        F.min(F.when(F.col("other") != F.col("own"), F.col("mean_dist"))).alias("b"),
    )
    s = (
        F.when(F.col("a").isNull() | F.col("b").isNull(), F.lit(0.0))
        .when(F.greatest("a", "b") == 0, F.lit(0.0))
        .otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    )
    # rows alone in their cluster have no pair row at all -> score 0
    base = cl.select("row_id", F.col("cluster").cast("int").alias("own"))
    return base.join(per_row, ["row_id", "own"], "left").select(
        "row_id", F.col("own").alias("cluster"), F.coalesce(s, F.lit(0.0)).alias("s")
    )


def silhouette(vecs: DataFrame, n: int | None = None, block_rows: int | None = None) -> float:
    """Mean exact silhouette over clustered rows; 0.0 with fewer than two clusters."""
    cl = clustered(vecs)
    k = cl.select("cluster").distinct().count()
    if k < 2:
        return 0.0
    r = silhouette_rows(vecs, n, block_rows).agg(F.avg("s")).first()[0]
    return float(r) if r is not None else 0.0


def silhouettes(vecs: DataFrame, n: int, block_rows: int | None = None) -> dict[int, float]:
    """Exact mean silhouette of several labelings in one quadratic pass.

    ``vecs`` is ``(row_id, x, labs array<int>)``; label -1 rows are left out
    (they are nobody's partner). Returns ``{model: silhouette}``; a labeling
    with fewer than two clusters scores 0.0. Distances are computed once per
    block pair for all labelings; no pair and no sample is ever materialised.
    """
    first = vecs.select(F.size("labs").alias("m"), F.size("x").alias("d")).first()
    if first is None:
        return {}
    n_models, d = int(first["m"]), int(first["d"])
    mx = vecs.select(*[F.max(F.col("labs")[m]).alias(f"k{m}") for m in range(n_models)]).first()
    ks = [max(1, int(mx[f"k{m}"]) + 1 if mx[f"k{m}"] is not None else 1) for m in range(n_models)]
    blocks = silhouette_blocks(n, d, vecs.sparkSession.sparkContext.defaultParallelism, block_rows)
    sums = multi_distance_sums(vecs, n, ks, blocks)
    aggs = []
    off = 0
    for m, k in enumerate(ks):
        own = F.col("labs")[m]
        mean = F.zip_with(
            F.slice("s", off + 1, k), F.slice("c", off + 1, k),
            lambda a, b: F.when(b > 0, a / b),
        )
        a = F.element_at(mean, own + 1)
        b = F.array_min(F.filter(
            F.transform(mean, lambda v, i: F.when(i != own, v)), lambda v: v.isNotNull()
        ))
        sil = (
            F.when(a.isNull() | b.isNull(), F.lit(0.0))
            .when(F.greatest(a, b) == 0, F.lit(0.0))
            .otherwise((b - a) / F.greatest(a, b))
        )
        aggs += [
            F.avg(F.when(own >= 0, sil)).alias(f"sil{m}"),
            F.count_distinct(F.when(own >= 0, own)).alias(f"k{m}"),
        ]
        off += k
    r = sums.agg(*aggs).first()
    return {m: (float(r[f"sil{m}"]) if r[f"k{m}"] >= 2 and r[f"sil{m}"] is not None else 0.0) for m in range(n_models)}


def noise_stats(labels: DataFrame) -> DataFrame:
    """``noise_rate`` (share of -1) and ``n_clusters`` (max id + 1)."""
    return labels.agg(
        F.avg((F.col("cluster") < 0).cast("double")).alias("noise_rate"),
        F.coalesce(F.max(F.when(F.col("cluster") >= 0, F.col("cluster"))) + 1, F.lit(0)).cast("int").alias("n_clusters"),
    )


def _comb2(c: Column) -> Column:
    return c * (c - 1) / 2.0


def adjusted_rand_index(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Adjusted Rand index of two label columns, one row ``ari``.

    Contingency counts come from one ``groupBy(a, b)`` (partial aggregation,
    so a label holding a third of the rows is one counter per partition);
    the marginals are windows over that small table. Identical partitions
    (including the degenerate all-in-one case) score 1.
    """
    from pyspark.sql import Window

    cont = pairs.groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("nij"))
    wa, wb = Window.partitionBy(a), Window.partitionBy(b)
    cont = (
        cont.withColumn("ni", F.sum("nij").over(wa)).withColumn("ca", F.count(F.lit(1)).over(wa))
        .withColumn("nj", F.sum("nij").over(wb)).withColumn("cb", F.count(F.lit(1)).over(wb))
    )
    t = cont.agg(
        F.sum(_comb2(F.col("nij"))).alias("sij"),
        F.sum("nij").alias("n"),
        F.sum(_comb2(F.col("ni")) / F.col("ca")).alias("sa"),
        F.sum(_comb2(F.col("nj")) / F.col("cb")).alias("sb"),
    )
    expected = F.col("sa") * F.col("sb") / _comb2(F.col("n"))
    maxi = (F.col("sa") + F.col("sb")) / 2.0
    return t.select(
        F.when((maxi - expected) == 0, F.lit(1.0))
        .otherwise((F.col("sij") - expected) / (maxi - expected))
        .alias("ari")
    )


def ari(labels_a: DataFrame, labels_b: DataFrame) -> float:
    """ARI of two labelings keyed by ``row_id`` (``cluster`` column each)."""
    p = labels_a.select("row_id", F.col("cluster").alias("a")).join(
        labels_b.select("row_id", F.col("cluster").alias("b")), "row_id"
    )
    return float(adjusted_rand_index(p).first()[0])


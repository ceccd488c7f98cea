"""Spark session helpers: session creation, checkpoint folder, lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def get_spark(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Return the active session, or build a local one for tests and benches.

    On a cluster the session already exists (spark-submit) and its settings
    win; the values below are only applied when a new local session is built.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        ensure_checkpoint_dir(active)
        return active
    master = master or os.environ.get("TESSERA_MASTER", "local[8]")
    # local Python workers inherit this process's environment: one BLAS
    # thread per task, since every core already runs its own task
    for var in ("OPENBLAS_NUM_THREADS", "OMP_NUM_THREADS", "MKL_NUM_THREADS"):
        os.environ.setdefault(var, "1")
    parts = shuffle_partitions or int(os.environ.get("TESSERA_SHUFFLE_PARTITIONS", "8"))
    spark = (
        SparkSession.builder.master(master)
        .appName("tessera")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TESSERA_DRIVER_MEMORY", "16g"))
        .config("spark.executorEnv.OPENBLAS_NUM_THREADS", "1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Make sure the SparkContext has a reliable checkpoint folder.

    The cluster names a shared folder in ``spark.checkpoint.dir``; we read it
    from the session. Only a local session without that setting (tests,
    benches) gets a scratch folder of its own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder "
            "(HDFS/object store) visible to every executor."
        )
    path = tempfile.mkdtemp(prefix="tessera-ckpt-", dir=os.environ.get("TESSERA_SCRATCH", "/tmp"))
    sc.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` into the reliable checkpoint folder.

    Used wherever a plan contains non-deterministic expressions (generated
    row ids) or iterative lineage: a lost executor then re-reads the
    checkpoint instead of recomputing different ids.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_round(df: DataFrame, left: Column | None = None) -> DataFrame | tuple[DataFrame, int]:
    """Write one round of a loop to the shared checkpoint folder and read it back.

    With ``left`` also the number of rows for which it holds, counted while writing.

    A checkpointed frame keeps what is known of the plan it came from (partitionings,
    orderings, constraints, estimated sizes); joined and renamed from round to round
    these multiply until planning takes longer than the work. A table read back has
    none of them but its true size, so joins with small rounds need no shuffle.
    """
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/round-{uuid.uuid4().hex}"
    schema, seen = df.schema, Observation()
    if left is not None:
        df = df.observe(seen, F.count_if(left).alias("n"))
    df.write.parquet(path)
    back = df.sparkSession.read.schema(schema).parquet(path)
    return back if left is None else (back, seen.get["n"])


def spread(df: DataFrame, key: str | None = None, per_core: int = 2) -> DataFrame:
    """Give an iteratively scanned frame at least ``per_core`` partitions per core.

    A small input (a few file splits) otherwise leaves most cores idle in every
    scan of an iterative fit; at cluster scale the frame already has far more
    partitions than cores and this is a no-op. Hash-partitioning on ``key``
    keeps a recomputed partition identical to the lost one.
    """
    target = df.sparkSession.sparkContext.defaultParallelism * per_core
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target, key) if key else df.repartition(target)


def hash_sample(df: DataFrame, fraction: float, seed: int, key: str = "row_id") -> DataFrame:
    """Seeded Bernoulli sample decided by a hash of ``key``.

    Unlike ``DataFrame.sample`` the kept rows do not depend on how the frame
    is partitioned, so a fit is reproducible on any cluster layout and a
    retried task keeps exactly the same rows.
    """
    if fraction >= 1.0:
        return df
    scale = 1 << 30
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(scale)) < F.lit(int(fraction * scale)))


def persist(df: DataFrame) -> DataFrame:
    """Cache a frame that several jobs scan; spills to disk instead of failing."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)

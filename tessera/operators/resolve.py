"""Feature resolution (F1-F12): two lookup joins, misses, coverage.

Hop 1 maps an external id (recovered from a catalog URL) to an internal id;
hop 2 maps internal ids to feature rows. Both lookup sides are deduplicated
per key first ("last row wins" by an explicit sequence column), so the joins
never fan out; the planner picks broadcast or sort-merge from the sizes it
sees, and AQE splits a hot key (one id repeated across a third of the rows)
on the track side. Remote lookups (F6-F8) run as a per-partition batched
fetch with a retry policy; a batch that still fails yields no rows and its
ids surface as misses through the anti join.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import id_from_href
from tessera.operators.prepare import ROW_ID
from tessera.spec import (
    BACKOFF_BASE,
    BACKOFF_CAP,
    LOOKUP_BATCH_SIZE,
    MAX_RETRIES,
    RETRY_STATUSES,
    TRACK_ID,
)


def last_wins(df: DataFrame, key: str, values: list[str], seq: str) -> DataFrame:
    """One row per ``key``: the values of the row with the highest ``seq``."""
    s = F.struct(*[F.col(c) for c in values])
    return df.groupBy(key).agg(F.max_by(s, F.col(seq)).alias("_v")).select(key, *[F.col(f"_v.{c}").alias(c) for c in values])


def catalog_mapping(catalog: DataFrame, href_col: str, id_col: str, seq: str) -> DataFrame:
    """``(ext_id, internal_id)`` from a catalog of (internal id, URL); both non-empty, last wins."""
    c = catalog.select(
        id_from_href(F.col(href_col)).alias("ext_id"),
        F.col(id_col).cast("string").alias("internal_id"),
        F.col(seq).alias("_seq"),
    ).where(F.col("ext_id").isNotNull() & F.col("internal_id").isNotNull() & (F.col("internal_id") != ""))
    return last_wins(c, "ext_id", ["internal_id"], "_seq")


def feature_table(features: DataFrame, id_col: str, feature_cols: list[str], seq: str) -> DataFrame:
    """``(internal_id, features...)`` with NULL-id rows skipped and the last row per id kept."""
    f = features.select(
        F.col(id_col).cast("string").alias("internal_id"),
        *[F.col(c).cast("double").alias(c) for c in feature_cols],
        F.col(seq).alias("_seq"),
    ).where(F.col("internal_id").isNotNull())
    return last_wins(f, "internal_id", feature_cols, "_seq")


def distinct_internal_ids(tracks: DataFrame, mapping: DataFrame, ext_col: str = TRACK_ID) -> DataFrame:
    """the internal ids hop 2 has to look up, each once."""
    ids = tracks.select(F.col(ext_col).alias("ext_id")).distinct()
    return ids.join(mapping, "ext_id").select("internal_id").distinct()


@dataclass
class Coverage:
    """how many rows resolved; ``dropped`` lists the others."""

    total: int
    resolved: int
    dropped: DataFrame

    @property
    def n_dropped(self) -> int:
        return self.total - self.resolved

    def render(self) -> str:
        pct = (100.0 * self.resolved / self.total) if self.total else 0.0
        return f"Resolved {self.resolved}/{self.total} rows ({pct:.0f}%); {self.n_dropped} dropped."


@dataclass
class Resolution:
    features: DataFrame  # identity + features, one row per resolved input row
    coverage: Coverage

    @property
    def dropped(self) -> DataFrame:
        return self.coverage.dropped


def resolve_features(
    tracks: DataFrame,
    mapping: DataFrame,
    feats: DataFrame,
    feature_cols: list[str],
    ext_col: str = TRACK_ID,
    identity: list[str] | None = None,
) -> Resolution:
    """``tracks`` (with ``row_id``) through both hops; duplicates kept."""
    identity = identity or [c for c in tracks.columns if c != ROW_ID]
    per_id = mapping.join(feats, "internal_id")  # ext_id -> features, one row per ext id
    resolved = tracks.join(per_id.withColumnRenamed("ext_id", ext_col), ext_col).select(
        ROW_ID, *identity, *feature_cols
    )
    dropped = tracks.join(resolved.select(ROW_ID), ROW_ID, "left_anti").select(ROW_ID, *identity)
    counts = tracks.select(ROW_ID).join(resolved.select(ROW_ID, F.lit(1).alias("_hit")), ROW_ID, "left").agg(
        F.count(F.lit(1)).alias("total"), F.count("_hit").alias("resolved")
    ).first()
    return Resolution(resolved, Coverage(int(counts["total"]), int(counts["resolved"]), dropped))


def dropped_preview(dropped: DataFrame, n: int = 20) -> list[str]:
    """a bounded list of dropped rows for a log line (never an unbounded print)."""
    cols = [c for c in dropped.columns if c != ROW_ID]
    return [" / ".join(str(r[c]) for c in cols) for r in dropped.orderBy(ROW_ID).limit(n).collect()]


# ---------------------------------------------------------------------------
# resolver registry
# ---------------------------------------------------------------------------

_RESOLVERS: dict[str, Callable[..., Resolution]] = {}


def register_resolver(mode: str, fn: Callable[..., Resolution]) -> None:
    _RESOLVERS[mode] = fn


def extract(tracks: DataFrame, resolver_args, mode: str = "precomputed") -> Resolution:
    """Dispatch to the resolver registered for ``mode``."""
    if mode not in _RESOLVERS:
        raise ValueError(f"Unknown feature mode {mode!r}; supported modes are {sorted(_RESOLVERS)!r}.")
    return _RESOLVERS[mode](tracks, **resolver_args)


def _precomputed(tracks: DataFrame, catalog: DataFrame, features: DataFrame, feature_cols: list[str],
                 href_col: str = "href", id_col: str = "id", seq: str = "seq") -> Resolution:
    mapping = catalog_mapping(catalog, href_col, id_col, seq)
    feats = feature_table(features, id_col, feature_cols, seq)
    return resolve_features(tracks, mapping, feats, feature_cols)


register_resolver("precomputed", _precomputed)


# ---------------------------------------------------------------------------
# Batched remote lookups with retries
# ---------------------------------------------------------------------------

class TransientError(Exception):
    """A retryable failure (HTTP 429 / 5xx / transport)."""

    def __init__(self, message: str = "", status: int | None = None, retry_after: float | None = None):
        super().__init__(message)
        self.status = status
        self.retry_after = retry_after


@dataclass(frozen=True)
class RetryPolicy:
    """F8: retry transient failures ``max_retries`` times with capped exponential backoff.

    A server-given ``retry_after`` in whole seconds wins over the computed delay and is
    waited out as it is; only the computed delay is capped. Anything else a server
    gives (a date, say) leaves the computed delay.
    """

    max_retries: int = MAX_RETRIES
    base: float = BACKOFF_BASE
    cap: float = BACKOFF_CAP
    retry_statuses: tuple[int, ...] = RETRY_STATUSES

    def retries(self, status: int | None) -> bool:
        """Transport failures (no status), every 5xx and the listed statuses are worth another try."""
        return status is None or status // 100 == 5 or status in self.retry_statuses

    def delay(self, attempt: int, retry_after: float | str | None = None) -> float:
        if retry_after is not None:
            try:
                return max(0.0, float(int(retry_after)))
            except ValueError:
                pass
        return min(self.base * (2 ** attempt), self.cap)

    def call(self, fn: Callable[[], object], sleep: Callable[[float], None] = time.sleep):
        """Run ``fn``; transient errors are retried, the last one re-raised."""
        attempt = 0
        while True:
            try:
                return fn()
            except TransientError as exc:
                if not self.retries(exc.status):
                    raise
                if attempt >= self.max_retries:
                    raise
                sleep(self.delay(attempt, exc.retry_after))
                attempt += 1


def chunked(items: list, size: int) -> Iterable[list]:
    """consecutive batches of at most ``size`` items."""
    for i in range(0, len(items), size):
        yield items[i:i + size]


def remote_lookup(
    ids: DataFrame,
    fetch: Callable[[list[str]], list[dict]],
    out_schema: str,
    *,
    id_col: str = "id",
    batch_size: int = LOOKUP_BATCH_SIZE,
    policy: RetryPolicy = RetryPolicy(),
    max_parallel: int | None = None,
    sleep: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """look ids up in batches from every partition; failed batches yield nothing.

    ``max_parallel`` bounds how many partitions (so concurrent callers) hit the
    remote service. ``fetch`` returns dicts whose keys match ``out_schema``.
    """
    src = ids.select(F.col(id_col).cast("string").alias("id"))
    if max_parallel:
        src = src.repartition(max_parallel)
    names = [f.split()[0] for f in out_schema.split(",")]

    def run(it):
        for pdf in it:
            batch_ids = [i for i in pdf["id"].tolist() if i]
            rows: list[dict] = []
            for batch in chunked(batch_ids, batch_size):
                try:
                    got = policy.call(lambda b=batch: fetch(b), sleep=sleep)
                except (TransientError, OSError):  # the service failed: misses; faults in ``fetch`` itself go up
                    continue
                if isinstance(got, list):
                    rows.extend(g for g in got if isinstance(g, dict))
            yield pd.DataFrame([{k: r.get(k) for k in names} for r in rows], columns=names)

    return src.mapInPandas(run, out_schema)


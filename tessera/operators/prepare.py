"""Preprocessing: cast, count missing, drop sparse rows, impute, transform, scale.

Every step is a projection or a single aggregate over the kept rows; the
fitted statistics (medians, means, scales) are a handful of doubles that
travel to the executors as literals inside the next projection.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.numeric import as_double, logit, sigmoid
from tessera.session import cut_lineage, persist, spread
from tessera.spec import MUSIC, FeatureSpec

ROW_ID = "row_id"


# ---------------------------------------------------------------------------
# exact median
# ---------------------------------------------------------------------------

def exact_medians(
    df: DataFrame,
    cols: list[str],
    *,
    accuracy: int = 20000,
    max_bracket_values: int = 200_000,
    extra_aggs: list[Column] | None = None,
) -> tuple[dict[str, float | None], dict[str, int], list]:
    """Exact median (mean of the two middle values) of each column, NULLs ignored.

    Spark's ``median``/``percentile`` buffers every distinct value of a
    column in one task; at scale that is unbounded. Instead:

    1. one aggregate: non-null count and an approximate quantile bracket
       ``[lo, hi]`` around the middle rank (rank error <= n/accuracy);
    2. one scan: rows below ``lo`` collapse to a single count per column,
       rows inside the bracket are counted per distinct value (partial
       aggregation map-side, so a value holding a third of all rows is one
       counter, not a hot task);
    3. the driver walks the few bracket values to the middle ranks.

    If a bracket ever holds too many distinct values it is narrowed with
    another quantile pass restricted to it, so nothing unbounded is collected.

    Returns ``(medians, non_null_counts, extra_results)``.
    """
    extra_aggs = extra_aggs or []
    if not cols:
        vals = df.agg(*extra_aggs).first() if extra_aggs else None
        return {}, {}, list(vals) if vals is not None else []
    margin = 3.0 / accuracy
    probes = [max(0.0, 0.5 - margin), min(1.0, 0.5 + margin)]
    aggs: list[Column] = []
    for i, c in enumerate(cols):
        aggs.append(F.count(F.col(c)).alias(f"n{i}"))
        aggs.append(F.percentile_approx(F.col(c), probes, accuracy).alias(f"q{i}"))
    row = df.agg(*aggs, *extra_aggs).first()
    extras = [row[len(aggs) + j] for j in range(len(extra_aggs))]

    medians: dict[str, float | None] = {}
    counts: dict[str, int] = {}
    pending: dict[str, dict] = {}
    for i, c in enumerate(cols):
        n = int(row[f"n{i}"])
        counts[c] = n
        if n == 0:
            medians[c] = None
            continue
        lo, hi = row[f"q{i}"]
        pending[c] = {"n": n, "lo": float(lo), "hi": float(hi),
                      "r_lo": (n - 1) // 2, "r_hi": n // 2}

    for _round in range(12):
        if not pending:
            break
        names = list(pending)
        parts = []
        for i, c in enumerate(names):
            st = pending[c]
            v = F.col(c)
            parts.append(
                F.when(v < F.lit(st["lo"]), F.struct(F.lit(i).alias("k"), F.lit(None).cast("double").alias("v")))
                .when(v <= F.lit(st["hi"]), F.struct(F.lit(i).alias("k"), v.alias("v")))
            )
        grouped = (
            df.select(F.explode(F.array(*parts)).alias("s"))
            .where(F.col("s").isNotNull())
            .groupBy(F.col("s.k").alias("k"), F.col("s.v").alias("v"))
            .agg(F.count(F.lit(1)).alias("cnt"))
        )
        got = grouped.limit(max_bracket_values + len(names) + 1).collect()
        if len(got) > max_bracket_values + len(names):
            _narrow(df, pending)
            continue
        per: dict[int, list] = {}
        for r in got:
            per.setdefault(r["k"], []).append((r["v"], int(r["cnt"])))
        for i, c in enumerate(names):
            st = pending[c]
            entries = per.get(i, [])
            below = sum(cnt for v, cnt in entries if v is None)
            inside = sorted((v, cnt) for v, cnt in entries if v is not None)
            total_inside = sum(cnt for _, cnt in inside)
            if below > st["r_lo"] or below + total_inside <= st["r_hi"]:
                st["lo"], st["hi"] = -math.inf, math.inf  # approximate bracket missed: widen
                continue
            v_lo = v_hi = None
            cum = below
            for v, cnt in inside:
                if v_lo is None and cum + cnt > st["r_lo"]:
                    v_lo = v
                if cum + cnt > st["r_hi"]:
                    v_hi = v
                    break
                cum += cnt
            medians[c] = v_lo + (v_hi - v_lo) * 0.5
            del pending[c]
    if pending:
        raise RuntimeError(f"median bracket did not converge for {sorted(pending)}")
    return {c: medians[c] for c in cols}, counts, extras


def _narrow(df: DataFrame, pending: dict[str, dict]) -> None:
    """Shrink every pending bracket with a quantile pass over the bracket rows only."""
    names = list(pending)
    aggs = []
    for i, c in enumerate(names):
        st = pending[c]
        v = F.col(c)
        aggs.append(F.count(F.when(v < F.lit(st["lo"]), 1)).alias(f"b{i}"))
        aggs.append(F.count(F.when((v >= F.lit(st["lo"])) & (v <= F.lit(st["hi"])), 1)).alias(f"m{i}"))
    r = df.agg(*aggs).first()
    accuracy = 20000
    aggs2 = []
    for i, c in enumerate(names):
        st = pending[c]
        below, inside = int(r[f"b{i}"]), max(1, int(r[f"m{i}"]))
        p_lo = (st["r_lo"] - below) / inside - 3.0 / accuracy
        p_hi = (st["r_hi"] - below) / inside + 3.0 / accuracy
        v = F.col(c)
        sel = F.when((v >= F.lit(st["lo"])) & (v <= F.lit(st["hi"])), v)
        aggs2.append(
            F.percentile_approx(sel, [min(1.0, max(0.0, p_lo)), min(1.0, max(0.0, p_hi))], accuracy).alias(f"q{i}")
        )
    r2 = df.agg(*aggs2).first()
    for i, c in enumerate(names):
        lo, hi = r2[f"q{i}"]
        pending[c]["lo"], pending[c]["hi"] = float(lo), float(hi)


# ---------------------------------------------------------------------------
# building blocks (each one a projection or a filter)
# ---------------------------------------------------------------------------

def cast_features(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Features to double, NaN to NULL; other columns untouched."""
    feats = set(spec.features)
    return df.select(*[as_double(c).alias(c) if c in feats else F.col(c) for c in df.columns])


def missing_count(spec: FeatureSpec) -> Column:
    """Number of NULL features in the row."""
    return sum((F.col(c).isNull().cast("int") for c in spec.features), F.lit(0))


def split_sparse(df: DataFrame, spec: FeatureSpec) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) where dropped rows have more than ``max_missing`` NULLs."""
    n = missing_count(spec)
    return df.where(n <= spec.max_missing), df.where(n > spec.max_missing)


def impute(df: DataFrame, medians: dict[str, float | None]) -> DataFrame:
    """P5: fill NULL feature cells with the column median."""
    out = []
    for c in df.columns:
        if c in medians and medians[c] is not None:
            out.append(F.coalesce(F.col(c), F.lit(float(medians[c]))).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def transform(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Logit on bounded columns, natural log on log columns."""
    out = []
    for c in df.columns:
        kind = spec.transform_of(c) if c in spec.features else None
        if kind == "logit":
            out.append(logit(c, spec.epsilon).alias(c))
        elif kind == "log":
            out.append(F.ln(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


@dataclass
class Scaler:
    """Per-column mean and population standard deviation (0 -> 1)."""

    columns: tuple[str, ...]
    mean: dict[str, float]
    scale: dict[str, float]

    @classmethod
    def fit(cls, df: DataFrame, columns: tuple[str, ...]) -> "Scaler":
        aggs = []
        for i, c in enumerate(columns):
            aggs += [F.avg(c).alias(f"m{i}"), F.stddev_pop(c).alias(f"s{i}")]
        r = df.agg(*aggs).first()
        mean = {c: float(r[f"m{i}"]) for i, c in enumerate(columns)}
        scale = {}
        for i, c in enumerate(columns):
            s = float(r[f"s{i}"] or 0.0)
            scale[c] = s if s > 0.0 else 1.0
        return cls(tuple(columns), mean, scale)

    def transform(self, df: DataFrame) -> DataFrame:
        cols = set(self.columns)
        return df.select(*[
            ((F.col(c) - F.lit(self.mean[c])) / F.lit(self.scale[c])).alias(c) if c in cols else F.col(c)
            for c in df.columns
        ])

    def inverse(self, df: DataFrame) -> DataFrame:
        cols = set(self.columns)
        return df.select(*[
            (F.col(c) * F.lit(self.scale[c]) + F.lit(self.mean[c])).alias(c) if c in cols else F.col(c)
            for c in df.columns
        ])


def inverse_transform(df: DataFrame, spec: FeatureSpec, scaler: Scaler) -> DataFrame:
    """Undo scaling, then sigmoid / exp; recovers the (clipped) imputed values."""
    un = scaler.inverse(df)
    out = []
    for c in un.columns:
        kind = spec.transform_of(c) if c in spec.features else None
        if kind == "logit":
            out.append(sigmoid(c).alias(c))
        elif kind == "log":
            out.append(F.exp(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return un.select(*out)


# ---------------------------------------------------------------------------
# orchestration
# ---------------------------------------------------------------------------

@dataclass
class TransformLog:
    """What preprocessing did; zero impute counts are omitted."""

    logit_columns: tuple[str, ...]
    log_columns: tuple[str, ...]
    imputed_counts: dict[str, int]
    dropped_rows: DataFrame
    n_input: int
    n_kept: int

    @property
    def n_dropped(self) -> int:
        return self.n_input - self.n_kept


@dataclass
class PreparedMatrix:
    """The modelling matrix: ``row_id`` + identity columns + scaled features."""

    matrix: DataFrame
    spec: FeatureSpec
    scaler: Scaler
    log: TransformLog
    medians: dict[str, float | None]
    n: int
    ids: tuple[str, ...] = field(default_factory=tuple)

    @property
    def features(self) -> tuple[str, ...]:
        return self.spec.features

    def vectors(self) -> DataFrame:
        """``(row_id, x array<double>)`` for the model sweeps."""
        return self.matrix.select(ROW_ID, F.array(*[F.col(c) for c in self.features]).alias("x"))


def with_row_id(df: DataFrame) -> DataFrame:
    """Attach a unique ``row_id`` once and materialise it (ids must not be recomputed)."""
    if ROW_ID in df.columns:
        return df
    return cut_lineage(df.withColumn(ROW_ID, F.monotonically_increasing_id()))


def prepare_matrix(features_df: DataFrame, spec: FeatureSpec = MUSIC, *, materialise: bool = True) -> PreparedMatrix:
    """Features frame -> scaled modelling matrix, dropped rows and logs."""
    missing = [c for c in spec.features if c not in features_df.columns]
    if missing:
        raise ValueError(f"features frame is missing feature column(s): {', '.join(missing)}")
    ids = tuple(c for c in spec.ids if c in features_df.columns)
    base = with_row_id(features_df.select(*([ROW_ID] if ROW_ID in features_df.columns else []), *ids, *spec.features))
    typed = cast_features(base, spec)
    kept, dropped = split_sparse(typed, spec)
    kept = persist(kept)
    extra = [F.count(F.lit(1)).alias("_n")]
    if spec.log:
        extra += [F.min(F.col(c)).alias(f"_min_{c}") for c in spec.log]
    endless = [F.coalesce((F.abs(F.col(c)) == float("inf")).cast("int"), F.lit(0)) for c in spec.features]
    extra += [F.max(e).alias(f"_inf_{c}") for c, e in zip(spec.features, endless)]
    medians, nonnull, extras = exact_medians(kept, list(spec.features), extra_aggs=extra)
    n_kept = int(extras[0])
    if n_kept == 0:
        kept.unpersist()
        if typed.isEmpty():
            raise ValueError("Cannot prepare a matrix from an empty features frame.")
        raise ValueError(
            f"Every row has more than {spec.max_missing} missing features; nothing left to cluster."
        )
    unbounded = [c for c, e in zip(spec.features, extras[1 + len(spec.log):]) if e]
    if unbounded:
        kept.unpersist()
        raise ValueError(f"infinite values in feature column(s): {', '.join(unbounded)}")
    for j, c in enumerate(spec.log):
        lowest = extras[1 + j]
        if lowest is not None and lowest <= 0:
            raise ValueError(f"log feature {c!r} has a non-positive value ({lowest}); cannot take ln.")
    imputed_counts = {c: n_kept - nonnull[c] for c in spec.features if n_kept - nonnull[c] > 0}
    transformed = transform(impute(kept, medians), spec)
    scaler = Scaler.fit(transformed, spec.features)
    matrix = scaler.transform(transformed)
    if materialise:
        matrix = cut_lineage(spread(matrix, ROW_ID))
    kept.unpersist()
    n_input = n_kept + dropped.count()
    log = TransformLog(
        logit_columns=tuple(spec.logit),
        log_columns=tuple(spec.log),
        imputed_counts=imputed_counts,
        dropped_rows=dropped.select(ROW_ID, *ids),
        n_input=n_input,
        n_kept=n_kept,
    )
    return PreparedMatrix(matrix=matrix, spec=spec, scaler=scaler, log=log, medians=medians, n=n_kept, ids=ids)

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import prepare as P
from tessera.spec import DEFAULT_FEATURES, MUSIC


def beta_features(n=40, seed=0):
    rng = np.random.default_rng(seed)
    df = pd.DataFrame({c: rng.beta(2, 5, size=n) for c in DEFAULT_FEATURES})
    df["tempo"] = rng.lognormal(np.log(110), 0.2, size=n)
    df["loudness"] = rng.normal(-8, 3, size=n)
    df.insert(0, "artist", "A")
    df.insert(0, "title", [f"t{i}" for i in range(n)])
    df.insert(0, "spotify_id", [f"s{i}" for i in range(n)])
    return df


def test_exact_median_even_count_averages_middle(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (5.0,), (7.0,), (None,)], "v double")
    med, counts, _ = P.exact_medians(df, ["v"])
    assert med["v"] == 3.5 and counts["v"] == 4


def test_exact_median_matches_numpy_on_skewed_data(spark):
    rng = np.random.default_rng(1)
    vals = np.concatenate([np.full(3000, 2.0), rng.normal(size=6001)])  # one value holds a third
    df = spark.createDataFrame(pd.DataFrame({"v": vals}))
    med, _, _ = P.exact_medians(df, ["v"], accuracy=50, max_bracket_values=100)
    assert med["v"] == pytest.approx(float(np.median(vals)))


def test_zscore_is_population(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "a double")
    sc = P.Scaler.fit(df, ("a",))
    assert sc.scale["a"] == pytest.approx(np.std([1, 2, 4]))
    const = P.Scaler.fit(spark.createDataFrame([(3.0,), (3.0,)], "a double"), ("a",))
    assert const.scale["a"] == 1.0


def test_prepare_drops_imputes_and_inverts(spark):
    pdf = beta_features()
    pdf.loc[2, ["acousticness", "danceability", "energy", "instrumentalness"]] = np.nan  # 4 missing -> dropped
    pdf.loc[3, "danceability"] = np.nan  # imputed
    pdf.loc[4, ["energy", "liveness", "valence"]] = np.nan  # 3 missing -> kept
    pm = P.prepare_matrix(spark.createDataFrame(pdf), MUSIC)
    assert pm.n == len(pdf) - 1
    assert [r["spotify_id"] for r in pm.log.dropped_rows.collect()] == ["s2"]
    assert pm.log.imputed_counts == {"danceability": 1, "energy": 1, "liveness": 1, "valence": 1}
    m = pm.matrix.toPandas()
    for c in DEFAULT_FEATURES:
        assert abs(m[c].mean()) < 1e-9 and m[c].std(ddof=0) == pytest.approx(1.0)
    back = P.inverse_transform(pm.matrix, MUSIC, pm.scaler).toPandas().set_index("spotify_id")
    src = pdf.set_index("spotify_id").drop(index="s2")
    kept = src["tempo"].notna()
    assert np.allclose(back.loc[kept.index, "tempo"], src["tempo"])
    clipped = src["acousticness"].clip(0.001, 0.999)
    ok = src["acousticness"].notna()
    assert np.allclose(back.loc[ok[ok].index, "acousticness"], clipped[ok])


def test_prepare_guards(spark):
    pdf = beta_features(6)
    with pytest.raises(ValueError, match="missing feature"):
        P.prepare_matrix(spark.createDataFrame(pdf.drop(columns=["tempo"])), MUSIC)
    bad = pdf.copy()
    bad.loc[0, "tempo"] = -1.0
    with pytest.raises(ValueError, match="non-positive"):
        P.prepare_matrix(spark.createDataFrame(bad), MUSIC)
    empty = spark.createDataFrame(pdf).where(F.lit(False))
    with pytest.raises(ValueError):
        P.prepare_matrix(empty, MUSIC)


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "a double")
    out = P.cast_features(df, MUSIC.__class__(features=("a",), logit=(), log=())).collect()
    assert out[0]["a"] is None


def test_infinite_cells_are_rejected(spark):
    frame = beta_features()
    frame.loc[3, "energy"] = float("inf")
    with pytest.raises(ValueError, match="infinite values.*energy"):
        P.prepare_matrix(spark.createDataFrame(frame))

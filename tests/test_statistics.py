import math

import numpy as np
import pandas as pd
import pytest

from tests.test_series import walk
from tidewater.functions.distributions import chi2_sf, f_sf, holm, normal_sf, t_two_sided
from tidewater.operators import hypothesis, learning
from tidewater.plans.zone_analysis import Result, analyze_zones, ao_zones, macd_zones, rsi_zones


@pytest.fixture(scope="module")
def result(spark, tmp_path_factory):
    """Saved and loaded, so that each test does not make the features again."""
    path = str(tmp_path_factory.mktemp("zones") / "r")
    macd_zones(spark.createDataFrame(walk(1500, 3))).save(path)
    return Result.load(spark, path)


def test_distributions_against_commons_math(spark):
    d = spark._jvm.org.apache.commons.math3.distribution
    for t in (0.1, 1.5, 4.0):
        for df in (1.0, 5.0, 300.0):
            assert math.isclose(t_two_sided(t, df), 2 * (1 - d.TDistribution(df).cumulativeProbability(t)), rel_tol=1e-7)
            assert math.isclose(chi2_sf(t, df), 1 - d.ChiSquaredDistribution(df).cumulativeProbability(t), rel_tol=1e-6, abs_tol=1e-12)
            assert math.isclose(f_sf(t, 3.0, df), 1 - d.FDistribution(3.0, df).cumulativeProbability(t), rel_tol=1e-7)
    assert math.isclose(normal_sf(1.96), 0.024997895, rel_tol=1e-6)
    assert holm([0.01, 0.04, 0.03]) == [0.03, 0.06, 0.06]


def test_suite(result):
    tests = hypothesis.run_all(result.features)
    assert set(tests) == set(hypothesis.TESTS)
    assert all(t["p_value"] is None or 0 <= t["p_value"] <= 1 for t in tests.values())
    assert hypothesis.normality(result.features, "price_return")["n"] > 10
    assert 0 <= hypothesis.mann_whitney(result.features, "duration", "type", "bull", "bear")["p_value"] <= 1


def test_adf_tells_walks_from_noise():
    rng = np.random.default_rng(0)
    assert hypothesis.adf(rng.normal(size=400))[1] < 0.01
    assert hypothesis.adf(np.cumsum(rng.normal(size=400)))[1] > 0.05


def whole_adf(x):
    """As statsmodels does it, on the whole array."""
    n, dx = len(x), np.diff(x)
    most = max(0, min(int(math.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2))

    def fit(lags, first):
        y = dx[first:]
        z = np.column_stack([x[first:-1], *[dx[first - k : len(dx) - k] for k in range(1, lags + 1)], np.ones(len(y))])
        b = np.linalg.lstsq(z, y, rcond=None)[0]
        return y, z, b, y - z @ b

    def aic(lags):
        y, z, _, e = fit(lags, most)
        return len(y) * (math.log(2 * math.pi * (e @ e) / len(y)) + 1) + 2 * z.shape[1]

    best = min(range(most + 1), key=aic)
    y, z, b, e = fit(best, best)
    return b[0] / math.sqrt(e @ e / (len(y) - z.shape[1]) * np.linalg.inv(z.T @ z)[0, 0]), best


def test_stationarity_of_each_series(spark):
    """One row a symbol, of any length and however the pieces fall."""
    rng = np.random.default_rng(5)
    series = {"a": rng.integers(1, 40, 300), "b": np.abs(np.cumsum(rng.integers(-3, 4, 25_000))) + 1, "c": np.full(30, 7), "d": rng.integers(1, 9, 5), "e": np.abs(np.cumsum(rng.integers(-3, 4, 101_000))) + 1, "f": rng.integers(1, 40, 12)}
    rows = pd.concat([pd.DataFrame({"symbol": s, "start_idx": np.arange(len(x)), "duration": x}) for s, x in series.items()]).sample(frac=1, random_state=1)
    f = spark.createDataFrame(rows).repartition(3)
    got = {r["symbol"]: r for r in hypothesis.duration_stationarity_of_series(f).collect()}
    assert set(got) == set(series) and got["c"]["error"] == "constant" and got["d"]["error"] == "too few rows"
    for s in "abef":
        x = series[s].astype(float)
        t, lags = whole_adf(x)
        assert got[s]["error"] is None and got[s]["lags"] == lags and math.isclose(got[s]["statistic"], t, rel_tol=1e-6) and got[s]["n"] == len(x)
        assert math.isclose(got[s]["trend"], np.corrcoef(np.arange(len(x)), x)[0, 1], rel_tol=1e-6)
    assert [r["symbol"] for r in hypothesis.run_all(f.where("symbol < 'c'"), ["duration_stationarity"])["duration_stationarity"]["series"]] == ["a", "b"]


def test_query_has_a_row_for_each_series(spark, sf):
    from tidewater.plans import catalog

    rows = catalog.queries()["duration_stationarity"](spark, sf).collect()
    symbols = {r["event_type"] for r in spark.read.parquet(f"{sf}/events.parquet").select("event_type").distinct().collect()}
    assert len(symbols) > 1 and {r["symbol"] for r in rows} == symbols
    assert all(r["error"] for r in rows if r["p_value"] is None)


def test_ols_equals_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 2))
    y = 3 + x @ [2.0, -1.0] + rng.normal(size=200)
    r = learning.ols(spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double"), "y", ["a", "b"])
    want = np.linalg.lstsq(np.column_stack([np.ones(200), x]), y, rcond=None)[0]
    assert np.allclose(list(r["coefficients"].values()), want)
    assert 0.5 < r["r2"] < 1 and r["p_values"]["a"] < 1e-10 and all(v >= 1 for v in r["vif"].values())
    with pytest.raises(ValueError):
        learning.ols(spark.createDataFrame([(1.0, 1.0)], "a double, y double"), "y", ["a"])


def test_clusters(result):
    c = learning.cluster_zones(result.features, 3)
    assert {r["cluster"] for r in c.select("cluster").distinct().collect()} == {0, 1, 2}
    q = learning.cluster_quality(c)
    assert q["calinski_harabasz"] > 0 and q["davies_bouldin"] > 0


def test_pipeline_save_and_load(spark, result):
    assert result.zones.count() == result.features.count() > 10
    assert result.bars.where("zone_id is null").count() == 0 and result.transitions().count() >= 2 and result.distribution().count() == 12


def test_presets_and_strategies(spark):
    d = spark.createDataFrame(walk(400, 9))
    assert rsi_zones(d).zones.count() > 0 and ao_zones(d).zones.count() > 0
    full = analyze_zones(d).with_indicator("custom", "macd").detect("zero_crossing", indicator="macd").with_swings("zigzag", preset="narrow_zone").with_strategies(divergence=True, volatility=True).build()
    assert {"num_swings", "divergence_count", "volatility_regime", "hist_skewness", "num_peaks"} <= set(full.features.columns)
    own = analyze_zones(d).with_indicator("custom", "macd").detect("zero_crossing", indicator="macd").with_swings("find_peaks", scope="per_zone").build()
    assert own.features.where("num_swings is null").count() == 0
    assert full.config.key("v1") != own.config.key("v1")

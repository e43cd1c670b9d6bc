"""Readers, tests, registries and caches against plain versions."""

import json
import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_series import walk
from tidewater.operators import bars, describe, hypothesis, indicators, learning, levels, robustness, swings, validation, zones
from tidewater.plans import catalog
from tidewater.plans.zone_analysis import Result, analyze_zones
from tidewater.sources import readers


def test_timeframe_names():
    known = {"1M": "1M", "1m": "1m", "M1": "1m", "120": "2h", "H2": "2h", "45": "45m", "Daily": "1d", "daily": "1d", "1W": "1w", "3M": "3M", "Monthly": "1M", "h4": "4h", "odd": "odd"}
    assert {k: readers.normal_timeframe(k) for k in known} == known
    assert all(bars.is_timeframe(v) for v in known.values() if v != "odd") and not bars.is_timeframe("odd")


def test_adjusted_closes_and_mixed_files(spark, tmp_path):
    (tmp_path / "AAA_1D.csv").write_text("Date,Open,High,Low,Close,Adj Close,Volume\n2024-01-01,1,2,0.5,1.5,1.4,10\n")
    d = readers.load_ohlcv(spark, str(tmp_path / "AAA_1D.csv")).first()
    assert (d["close"], d["adj_close"]) == (1.5, 1.4)
    (tmp_path / "BBB_1D.csv").write_bytes("Date,Open,High,Low,Close,Größe\n2024-01-01,1,2,0.5,2.5,1\n".encode("utf-16"))
    (tmp_path / "CCC_1D.csv").write_bytes("Date,Open,High,Low,Close,Größe €\n2024-01-01,1,2,0.5,3.5,1\n".encode("windows-1252"))
    (tmp_path / "DDDM15.csv").write_text("2024.01.01 00:00,1,2,0.5,4.5,7\n")
    both = readers.load_directory(spark, str(tmp_path))
    assert {"größe", "größe €", "adj_close"} <= set(both.columns)
    got = {r["symbol"]: r["close"] for r in both.collect()}
    assert got == {"AAA": 1.5, "BBB": 2.5, "CCC": 3.5, "DDD": 4.5}
    with pytest.raises(ValueError):
        readers.load_ohlcv(spark, str(tmp_path / "none*.csv"))
    (tmp_path / "s.json").write_text(json.dumps({"symbols": ["A"], "fast": 12}))
    assert readers.load_settings(spark, str(tmp_path / "s.json"))["fast"] == 12


def test_samples(spark):
    s = readers.Samples()
    info = {r["column"]: r for r in s.info(spark, "xauusd_1h").collect()}
    assert info["close"]["n"] == 1000 and info["close"]["missing_pct"] == 0 and info["close"]["min"] <= info["close"]["mean"] <= info["close"]["max"]
    assert s.integrity(spark, "xauusd_1h")["whole"] and s.compare(spark, "xauusd_1h", "xauusd_15m")["attributes"]["timeframe"] == ("1h", "15m")


def test_resample_by_months(spark):
    f = walk(24 * 200)
    got = {r["ts"].month: r["n_bars"] for r in bars.resample(spark.createDataFrame(f), "6M").collect()}
    assert got == {1: 24 * 182, 7: 24 * 18}


def test_inversions():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 17, 64, 257):
        x = rng.integers(0, 20, n).astype(float)
        assert describe.inversions(x) == sum(a > b for a, b in combinations(x, 2))


def test_correlations_with_p(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 12, 200).astype(float)
    y = x + rng.integers(0, 20, 200)
    d = spark.createDataFrame([("k", float(a), float(b)) for a, b in zip(x, y)] + [("few", 1.0, 2.0)], "s string, a double, b double")
    got = {(r["s"], r["method"]): r for r in describe.correlation_tests(d, "a", "b", ["s"]).collect()}
    t = spark._jvm.org.apache.commons.math3.distribution.TDistribution(198.0)
    r = float(np.corrcoef(x, y)[0, 1])
    assert math.isclose(got["k", "pearson"]["r"], r) and math.isclose(got["k", "pearson"]["p_value"], 2 * (1 - t.cumulativeProbability(r * math.sqrt(198 / (1 - r * r)))), rel_tol=1e-3, abs_tol=1e-12)
    s = sum(np.sign(a - c) * np.sign(b - e) for (a, b), (c, e) in combinations(zip(x, y), 2))
    ties = lambda v: sum(n * (n - 1) / 2 for n in np.unique(v, return_counts=True)[1])
    assert math.isclose(got["k", "kendall"]["r"], s / math.sqrt((19900 - ties(x)) * (19900 - ties(y)))) and got["k", "kendall"]["significant"]
    assert got["few", "pearson"]["p_value"] is None and not got["few", "kendall"]["significant"]


def test_shapiro():
    w, p = hypothesis.shapiro(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236.0]))
    assert abs(w - 0.79) < 0.005 and abs(p - 0.0067) < 0.001  # the example of the test's authors
    rng = np.random.default_rng(3)
    assert hypothesis.shapiro(rng.normal(size=200))[1] > 0.05 > hypothesis.shapiro(rng.exponential(size=200))[1]
    assert 0.99 < hypothesis.shapiro(np.array([1.0, 2.0, 3.0]))[0] <= 1


def test_normality_equals_plain_version(spark):
    rng = np.random.default_rng(4)
    x = np.sort(np.concatenate([rng.normal(size=300).round(2), [0.5] * 40]))
    r = hypothesis.normality(spark.createDataFrame([(float(v),) for v in x], "x double").repartition(5), "x")
    n, z = len(x), (x - x.mean()) / x.std(ddof=1)
    p = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in z])
    i = np.arange(1, n + 1)
    assert math.isclose(r["ks"], max((i / n - p).max(), (p - (i - 1) / n).max()), abs_tol=1e-6)
    assert math.isclose(r["anderson"], -n - ((2 * i - 1) * (np.log(p) + np.log(1 - p[::-1]))).sum() / n, rel_tol=1e-4)
    assert r["shapiro_p"] < 0.05


def test_support_resistance_effect(spark):
    rng = np.random.default_rng(5)
    rows = [("a", 100.0, 200.0, int(rng.integers(20, 40))) for _ in range(30)] + [("a", 137.0 + 1.9 * k, 137.9 + 1.9 * k, int(rng.integers(2, 8))) for k in range(12)]
    f = spark.createDataFrame(rows, "symbol string, start_price double, end_price double, duration long")
    given = spark.createDataFrame([("a", 100.0)], "symbol string, level double")
    r = hypothesis.support_resistance_effect(f, given)
    assert r["near"] == 30 and r["far"] == 12 and r["significant"] and r["mean_near"] > r["mean_far"]
    assert hypothesis.support_resistance_effect(f)["n"] == 42
    assert hypothesis.support_resistance_effect(f.limit(0), given)["error"]


def test_near_levels_at_the_edges(spark):
    prices = [0.0, 99.0, 99.00001, 100.0, 101.0, 101.00001, 98.99, -1.0, None]
    d = spark.createDataFrame([("a", p) for p in prices], "symbol string, p double")
    lv = spark.createDataFrame([("a", 100.0), ("a", 0.0), ("b", 98.99)], "symbol string, level double")
    near = [r["p"] for r in levels.near_levels(d, lv, "p").collect()]
    assert sorted(near) == [0.0, 99.0, 99.00001, 100.0, 101.0]
    assert levels.near_levels(d, lv, "p", near=False).count() == len(prices) - len(near)


def test_peaks_equal_plain_version():
    rng = np.random.default_rng(6)
    for n in (5, 60, 300):
        x = rng.integers(0, 30, n).astype(float)
        peaks = swings.local_peaks(x)
        order = sorted(peaks.tolist(), key=lambda p: (x[p], p), reverse=True)
        kept = []
        for p in order:
            if all(abs(p - q) >= 4 for q in kept):
                kept.append(p)

        def stands_out(p):
            left = [k for k in range(p) if x[k] > x[p]]
            right = [k for k in range(p + 1, n) if x[k] > x[p]]
            a, b = (left[-1] + 1 if left else 0), (right[0] if right else n)
            return x[p] - max(x[a : p + 1].min(), x[p:b].min())

        want = sorted(p for p in kept if stands_out(p) >= 5)
        assert swings.local_peaks(x, distance=4, prominence=5.0).tolist() == want


def test_simulated_bars_keep_their_shape(spark):
    f = walk(40)
    f["open"], f["high"], f["low"] = f["close"] * 1.01, f["close"] * 1.02, f["close"] * 0.98
    for how in ("shuffle_returns", "shuffle_prices", "gaussian"):
        s = robustness.simulate(spark.createDataFrame(f), 3, how=how, whole=True).toPandas()
        assert len(s) == 120 and np.allclose(s["high"] / s["close"], 1.02) and np.allclose(s["open"] / s["close"], 1.01)
        assert s.groupby("sim").ts.nunique().eq(40).all()
        if how == "shuffle_returns":
            last = s[s.bar_idx == 39]
            assert np.allclose(last["close"], f["close"].iloc[-1])


def test_registries(spark):
    d = spark.createDataFrame(walk(50))
    assert indicators.find_oscillator(d) is None and indicators.find_oscillator(indicators.rsi(d)) == "rsi_14"
    assert indicators.least_bars("macd", slow=30, signal=5) == 35 and indicators.least_bars("rsi") == 15 and indicators.least_bars("unheard of") == 1
    assert indicators.register_library("no_such_library") == []
    assert indicators.register_library("tests.fake_library") == ["bands", "midpoint"]
    got = indicators.create("library", "midpoint", length=2)(d).orderBy("bar_idx").toPandas()
    f = walk(50)
    assert np.allclose(got["midpoint"].iloc[1:], ((f.high + f.low) / 2).rolling(2).mean().iloc[1:])
    two = indicators.create("library", "bands", outputs=("up", "down"))(d).where("up - down <> 4").count()
    assert two == 0
    both = indicators.combined(d, {"a": lambda x: indicators.sma(x, 5, out="m"), "b": lambda x: indicators.sma(x, 9, out="m")})
    assert both.columns[-2:] == ["m", "b_m"] and both.where("bar_idx = 20 and m = b_m").count() == 0


def test_indicators_in_chunks(spark):
    """As over whole series, in many tasks for one series."""
    f = walk(5000, 3)
    f["high"] += np.arange(5000) % 7
    d = spark.createDataFrame(f).repartition(3)
    for name, parameters in (("macd", {}), ("macd", {"adjust": False}), ("rsi", {"period": 5}), ("sma", {"period": 50}), ("bbands", {}), ("ao", {}), ("atr", {}), ("ema", {"period": 9})):
        whole, parts = (indicators.create("custom", name, chunk, **parameters)(d) for chunk in (None, 1000))
        assert whole.columns == parts.columns
        a, b = (x.toPandas().sort_values("bar_idx", ignore_index=True) for x in (whole, parts))
        assert len(a) == len(b)
        for c in a.columns[8:]:
            assert np.allclose(a[c].astype(float), b[c].astype(float), rtol=1e-9, atol=1e-10, equal_nan=True), (name, c)
    tasks = indicators.create("custom", "sma", 100, period=5)(d).select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 1
    with pytest.raises(ValueError):
        indicators.create("custom", "sma", 10, period=50)(d)
    with pytest.raises(ValueError):
        indicators.create("custom", "unknown", 10)


def test_library_names_and_records(spark, tmp_path):
    from tidewater.operators import features
    from tidewater.plans import report
    from tidewater.sources import writers

    f = walk(120, 4)
    d = spark.createDataFrame(f)
    assert indicators.create("pandas_ta", "rsi")(d).columns[-1] == "RSI_14" and indicators.create("pandas_ta", "ao")(d).columns[-1] == "AO_5_34"
    got = indicators.create("talib", "bbands")(d).orderBy("bar_idx").toPandas()
    assert np.allclose(got["bb_middle"].iloc[4:], f.close.rolling(5).mean().iloc[4:])
    pre = indicators.create("preloaded", "macd")(indicators.macd(d).withColumnRenamed("macd_signal", "signal"))
    assert pre.where("abs(macd - macd_signal - macd_hist) > 1e-12").count() == 0
    assert bars.crossings(pre, "macd", "macd_signal", lookback=60).where("bar_idx < 60").count() == 0
    rows = [{"time": "2024-01-01 00:00:00", "open": "1", "high": 2, "low": "x", "close": 1.5}, {"time": "bad", "open": None, "high": 2, "low": 1, "close": 1, "extra": 7}]
    a, b = sorted(readers.from_records(spark, rows, "S").collect(), key=lambda r: r["extra"] or 0)
    assert (a["open"], a["low"], a["symbol"]) == (1.0, None, "S") and (b["ts"], b["open"], b["extra"]) == (None, None, 7.0)
    features.register_strategy("shape", "length", lambda zoned, indicator, factor=1: zoned.groupBy("symbol", "zone_id").agg((F.count(F.lit(1)) * factor).alias("bars")))
    plan = analyze_zones(d).with_indicator("custom", "macd").detect("zero_crossing", indicator="macd").with_swings(None).with_features("shape", "length", factor=2)
    result = plan.build()
    assert "length" in features.strategies()["shape"] and result.features.where("bars <> 2 * duration").count() == 0
    with pytest.raises(ValueError):
        plan.with_features("shape", "unheard of")
    said = report.macd_report(result.bars, result.zones)
    for kind, part in (("json", "recommendation"), ("text", "recommendation:"), ("html", "<th>recommendation</th>")):
        writers.write_report(said, str(tmp_path / kind), kind, "MACD")
        assert part in "".join(p.read_text() for p in (tmp_path / kind).glob("part-*"))


def test_validators(spark):
    d = spark.createDataFrame(walk(150))
    assert validation.require(d) is d and validation.usable(d, ("close",)) and not validation.usable(d.limit(0)) and not validation.usable(d, ("none",))
    for broken in (d.drop("open"), d.limit(0), d.withColumn("high", F.col("low") - 1)):
        with pytest.raises(ValueError):
            validation.require(broken)


def test_results_are_kept_whole(spark, tmp_path):
    plan = analyze_zones(spark.createDataFrame(walk(300, 3))).with_indicator("custom", "macd", fast=10).detect("zero_crossing", indicator="macd").with_swings("pivot_points", auto=True)
    first = plan.cached(str(tmp_path), "1")
    assert first.config == plan.config and first.features.count() > 3
    tests = first.hypothesis_tests()
    first.save(str(tmp_path / "more"))
    again = Result.load(spark, str(tmp_path / "more"))
    assert again.config == plan.config and again.memo["tests"].keys() == tests.keys()
    folders = {p.name for p in tmp_path.iterdir()}
    plan.cached(str(tmp_path), "1")
    assert {p.name for p in tmp_path.iterdir()} == folders
    plan.cached(str(tmp_path), "2")
    assert len({p.name for p in tmp_path.iterdir()}) == len(folders) + 1


def test_auto_thresholds_reach_detection(spark):
    f = walk(400, 8)
    d = spark.createDataFrame(f)
    limits = swings.auto_thresholds(d).first()
    for strategy, fixed in (("zigzag", swings.zigzag_points(d, limits["zigzag_deviation"])), ("find_peaks", swings.peak_points(d, limits["peak_prominence"]))):
        points, least = swings.with_auto_thresholds(d, strategy)
        assert sorted(map(tuple, points.collect()), key=str) == sorted(map(tuple, fixed.collect()), key=str)
        assert least.first()["min_amplitude_pct"] == (0.0 if strategy == "zigzag" else limits["peak_prominence"])


def test_analysis_of_columns(spark):
    d = spark.createDataFrame(walk(60)).withColumn("x", F.col("bar_idx") * 1.0)
    r = hypothesis.analyze(d, ["close", "x"])
    assert r["descriptive"].count() == 2 and r["normality"]["x"]["n"] == 60 and r["correlations"]["close_vs_x"].count() == 3
    with pytest.raises(ValueError):
        hypothesis.analyze(d, ["none"])


def test_clusters(spark, sf):
    """Each zone is in the cluster of the nearest centre; profiles are the clusters' figures."""
    f = catalog._features(spark, sf).toPandas()
    c = learning.cluster_zones(spark.createDataFrame(f.drop(columns=["atr_normalized_return"])), 3).toPandas()
    z = c[[x for x in c.columns if x.startswith("z_")]].to_numpy()
    centres = np.array([z[c.cluster == k].mean(0) for k in range(3)])
    nearest = ((z[:, None] - centres[None]) ** 2).sum(2).argmin(1)
    assert (nearest == c.cluster.to_numpy()).mean() > 0.98
    profiles = {r["cluster"]: r for r in catalog.queries()["zone_clusters"](spark, sf).collect()}
    assert sum(r["size"] for r in profiles.values()) == len(f) and len(profiles) == 3
    total = sum(r["size"] * r["duration_mean"] for r in profiles.values())
    assert math.isclose(total, f.duration.sum(), rel_tol=1e-5)
    quality = learning.cluster_quality(spark.createDataFrame(c.drop(columns=[x for x in c.columns if c[x].isna().all()])))
    d2 = ((z[:, None] - z[None]) ** 2).sum(2)
    s = []
    for i in range(len(z)):
        own = c.cluster.to_numpy() == c.cluster.iloc[i]
        if own.sum() == 1:
            s.append(0.0)
            continue
        a = d2[i, own].sum() / (own.sum() - 1)
        b = min(d2[i, c.cluster.to_numpy() == k].mean() for k in range(3) if k != c.cluster.iloc[i])
        s.append((b - a) / max(a, b))
    assert math.isclose(quality["silhouette"], np.mean(s), abs_tol=1e-6)


def test_stationarity_of_each_series(spark, sf):
    from tests.test_statistics import whole_adf

    f = catalog._features(spark, sf).select("symbol", "start_idx", "duration").toPandas()
    got = {r["symbol"]: r for r in catalog.queries()["duration_stationarity"](spark, sf).collect()}
    assert set(got) == set(f.symbol)
    for symbol, own in f.groupby("symbol"):
        x = own.sort_values("start_idx").duration.to_numpy(float)
        if got[symbol]["error"] is None:
            assert math.isclose(got[symbol]["statistic"], whole_adf(x)[0], abs_tol=1e-4)


def test_regressions_equal_least_squares(spark, sf):
    f = catalog._features(spark, sf).toPandas()
    names = ["macd_amplitude", "hist_amplitude", "price_range_pct"]
    d = spark.createDataFrame(f[["duration", *names]].rename(columns={"hist_amplitude": "other"}))
    r = learning.ols(d, "duration", ["macd_amplitude", "price_range_pct"])
    x = np.column_stack([np.ones(len(f)), f.macd_amplitude, f.price_range_pct])
    b, *_ = np.linalg.lstsq(x, f.duration.to_numpy(float), rcond=None)
    assert np.allclose([*r["coefficients"].values()], b, rtol=1e-6)
    assert learning.duration_regression(spark.createDataFrame(f[["duration", *names]]))["n"] == len(f)


def test_islands_read_bars_once(spark, sf):
    plan = zones.zero_crossing(indicators.macd(catalog._bars(spark, sf)), "macd")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and "Join" not in plan

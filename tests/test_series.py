import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewater.functions.ewm import ewm_mean
from tidewater.functions.series import no_nan
from tidewater.operators import indicators, zones
from tidewater.operators.bars import numbered


def walk(n, seed=0, symbol="a"):
    rng = np.random.default_rng(seed)
    close = 100 + np.cumsum(rng.normal(size=n))
    return pd.DataFrame({"symbol": symbol, "ts": pd.date_range("2024-01-01", periods=n, freq="h"), "bar_idx": np.arange(n), "open": close, "high": close + 1, "low": close - 1, "close": close, "volume": 1000.0})


@pytest.mark.parametrize("n", [1, 2, 40, 5000])
@pytest.mark.parametrize("adjust", [True, False])
def test_ewm_equals_pandas(spark, n, adjust):
    f = walk(n)
    got = ewm_mean(spark.createDataFrame(f), {"e": ("close", 2 / 13, adjust), "q": ("close", 0.9, adjust)}).toPandas().sort_values("bar_idx")
    for c, a in (("e", 2 / 13), ("q", 0.9)):
        assert np.allclose(got[c], f["close"].ewm(alpha=a, adjust=adjust).mean(), rtol=1e-11)


def test_ewm_with_missing_values(spark):
    f = walk(60)
    f.loc[[0, 1, 30, 31], "close"] = np.nan
    d = no_nan(spark.createDataFrame(f))
    got = ewm_mean(d, {"e": ("close", 0.2, True), "u": ("close", 0.2, False)}).toPandas().sort_values("bar_idx")
    assert np.allclose(got["e"], f["close"].ewm(alpha=0.2).mean(), equal_nan=True)
    assert np.allclose(got["u"], f["close"].ewm(alpha=0.2, adjust=False, ignore_na=True).mean(), equal_nan=True)


def test_row_order_and_partitions_do_not_matter(spark):
    f = pd.concat([walk(300, 1, "a"), walk(200, 2, "b")])
    d = spark.createDataFrame(f)
    one = zones.zone_table(zones.zero_crossing(indicators.macd(d), "macd")).toPandas()
    two = zones.zone_table(zones.zero_crossing(indicators.macd(d.orderBy(F.rand(3)).repartition(7)), "macd")).toPandas()
    key = ["symbol", "zone_id"]
    pd.testing.assert_frame_equal(one.sort_values(key, ignore_index=True), two.sort_values(key, ignore_index=True))
    alone = zones.zone_table(zones.zero_crossing(indicators.macd(spark.createDataFrame(walk(300, 1, "a"))), "macd")).toPandas()
    pd.testing.assert_frame_equal(one[one.symbol == "a"].sort_values(key, ignore_index=True), alone.sort_values(key, ignore_index=True))


def series(spark, values, name="x"):
    return numbered(spark.createDataFrame([("s", k, None if v is None else float(v)) for k, v in enumerate(values)], f"symbol string, ts long, {name} double"))


def found(df):
    return [(r["type"], r["start_idx"], r["end_idx"]) for r in zones.zone_table(df).orderBy("zone_id").collect()]


def test_zero_crossing_rules(spark):
    assert found(zones.zero_crossing(series(spark, [None, 1, 0, -1, -2, 3, 3]), "x")) == [("bull", 1, 2), ("bear", 3, 4), ("bull", 5, 6)]
    assert found(zones.zero_crossing(series(spark, [1, 2, 3]), "x")) == []
    assert found(zones.zero_crossing(series(spark, [1, 2, -3, 1, 1]), "x", min_duration=1)) == [("bull", 0, 1), ("bear", 2, 2), ("bull", 3, 4)]
    assert found(zones.zero_crossing(series(spark, [1, 1, -3, -1]), "x", types=("bear",))) == [("bear", 2, 3)]
    assert found(zones.zero_crossing(series(spark, []), "x")) == []


def test_threshold_and_combined_rules(spark):
    s = series(spark, [None, 50, 50, 80, 81, 20, 20, 30])
    assert found(zones.threshold(s, "x", 70, 30)) == [("neutral", 1, 2), ("overbought", 3, 4), ("oversold", 5, 6)]
    assert found(zones.threshold(series(spark, [50, 50, 50]), "x", 70, 30)) == [("neutral", 0, 2)]
    with pytest.raises(ValueError):
        zones.threshold(s, "x", 30, 70)
    assert found(zones.combined(s, ["x > 40", "x < 81"], "and")) == [("active", 1, 3), ("inactive", 4, 7)]
    with pytest.raises(ValueError):
        zones.detect(s, "threshold", indicator="x")


def test_rsi_edges(spark):
    d = series(spark, [1, 2, 3, 4], "close")
    assert [r["rsi_14"] for r in indicators.rsi(d).orderBy("bar_idx").collect()] == [None, 100.0, 100.0, 100.0]
    flat = series(spark, [5, 5, 5], "close")
    assert [r["rsi_14"] for r in indicators.rsi(flat).collect()] == [None, None, None]


def test_registry(spark):
    indicators.register("double", lambda df, by=2: df.withColumn("d", F.col("close") * by))
    assert "double" in indicators.available()["custom"]
    assert indicators.create("custom", "double", by=3)(series(spark, [1], "close")).first()["d"] == 3.0
    with pytest.raises(ValueError):
        indicators.create("custom", "nothing")
    with pytest.raises(ValueError):
        indicators.preloaded(series(spark, [1]), {"symbol": "y"})

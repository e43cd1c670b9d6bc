import numpy as np
import pandas as pd

from tests.test_series import walk
from tidewater.operators import swings
from tidewater.operators.swings import local_peaks


def test_local_peaks():
    assert local_peaks(np.array([0, 1, 0, 2, 0.0])).tolist() == [1, 3]
    assert local_peaks(np.array([0, 2, 2, 2, 0.0])).tolist() == [2]  # the middle of a plateau
    assert local_peaks(np.array([2, 1, 2.0])).tolist() == []  # ends are none
    assert local_peaks(np.array([0, 1, 0, 2, 0.0]), height=1.5).tolist() == [3]
    assert local_peaks(np.array([0, 3, 0, 2, 0, 4, 0.0]), distance=3).tolist() == [1, 5]
    assert local_peaks(np.array([0, 5, 4, 4.5, 0, 3, 0.0]), prominence=1.0).tolist() == [1, 5]
    assert local_peaks(np.array([])).tolist() == []


def test_pivots_and_movements(spark):
    f = walk(9)
    f["high"] = [1, 2, 5, 2, 1, 2, 6, 2, 1.0]
    f["low"] = f["high"] - 1
    d = spark.createDataFrame(f)
    p = swings.pivot_points(d).orderBy("bar_idx").collect()
    assert [(r["bar_idx"], r["swing_type"], r["price"], r["confirmation_index"]) for r in p] == [(2, "peak", 5.0, 4), (4, "trough", 0.0, 6), (6, "peak", 6.0, 8)]
    linked = swings.linked(swings.pivot_points(d)).orderBy("point_id").collect()
    assert linked[0]["amplitude_to_next"] == -100.0 and linked[0]["duration_to_next"] == 2 and linked[2]["duration_to_next"] is None
    assert linked[1]["amplitude_to_next"] is None  # from price zero


def test_replay_is_causal(spark):
    """Pivots confirmed on the first bars stay as more bars come."""
    f = walk(400, 5)
    for make in (lambda d: swings.pivot_points(d), lambda d: swings.zigzag_points(d, 0.02, 3)):
        whole, half = (make(spark.createDataFrame(x)).toPandas() for x in (f, f[:250]))
        early = whole[whole.confirmation_index < 250].sort_values(["bar_idx", "swing_type"], ignore_index=True)
        pd.testing.assert_frame_equal(early, half[half.confirmation_index < 250].sort_values(["bar_idx", "swing_type"], ignore_index=True))


def test_zigzag_alternates(spark):
    p = swings.zigzag_points(spark.createDataFrame(walk(500, 7)), 0.03, 3).orderBy("bar_idx").collect()
    kinds = [r["swing_type"] for r in p]
    assert len(kinds) > 4 and all(a != b for a, b in zip(kinds, kinds[1:]))
    flat = walk(50)
    flat[["high", "low"]] = 5.0
    assert swings.zigzag_points(spark.createDataFrame(flat)).count() == 0


def test_zone_takes_one_neighbour_on_each_side(spark):
    points = spark.createDataFrame([("a", k, float(k + 1), "peak" if k % 20 else "trough") for k in range(0, 100, 10)], "symbol string, bar_idx long, price double, swing_type string")
    zone = spark.createDataFrame([("a", 0, "bull", 35, 52)], "symbol string, zone_id long, type string, start_idx long, end_idx long")
    assert sorted(r["bar_idx"] for r in swings.in_zones(points, zone, bin_bars=16).collect()) == [30, 40, 50, 60]

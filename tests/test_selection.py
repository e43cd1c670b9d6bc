from pyspark.sql import functions as F

from tests.test_series import walk
from tidewater.operators import selection


def test_surroundings_and_ranges(spark):
    b = spark.createDataFrame(walk(60)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    z = spark.createDataFrame([("a", 0, "bull", 2, 4), ("a", 1, "bear", 30, 40)], "symbol string, zone_id long, type string, start_idx long, end_idx long")
    s = selection.surroundings(b, z, 5, bin_bars=8).groupBy("zone_id").agg(F.min("bar_idx"), F.max("bar_idx"), F.count_if("in_zone")).orderBy("zone_id").collect()
    assert [tuple(r) for r in s] == [(0, 0, 9, 3), (1, 25, 45, 11)]
    assert selection.surroundings(b, z, 5, most=4).where("zone_id = 1").agg(F.min("bar_idx")).first()[0] == 42
    t = z.join(b.select(F.col("bar_idx").alias("start_idx"), F.col("ts").alias("start_time")), "start_idx").join(b.select(F.col("bar_idx").alias("end_idx"), F.col("ts").alias("end_time")), "end_idx")
    assert [r["zone_id"] for r in selection.zones_between(t, "2024-01-01 04:00:00", "2024-01-01 10:00:00").collect()] == [0]
    assert selection.zones_between(t).count() == 2


def test_as_of_and_nearest(spark):
    rows = lambda xs, extra: spark.createDataFrame([("a", *x) for x in xs], f"symbol string, ts string{extra}").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    right = rows([("2024-01-01 01:00:00", 1.0), ("2024-01-01 03:00:00", 3.0)], ", v double")
    left = rows([("2024-01-01 00:30:00",), ("2024-01-01 01:00:00",), ("2024-01-01 02:59:00",), ("2024-01-01 05:00:00",)], "")
    assert [r["v"] for r in selection.as_of(left, right, "v").orderBy("ts").collect()] == [None, 1.0, 1.0, 3.0]
    bars = rows([("2024-01-01 01:00:00", 0), ("2024-01-01 03:00:00", 1)], ", bar_idx long")
    stamps = rows([("2024-01-01 00:00:00",), ("2024-01-01 02:00:00",), ("2024-01-01 02:01:00",), ("2024-01-01 09:00:00",)], "")
    assert [r["bar_idx"] for r in selection.nearest_bar(bars, stamps).orderBy("ts").collect()] == [0, 0, 1, 1]


def test_batch_summary(spark):
    f = spark.createDataFrame([("a", "1h", "bull", 2, 0.1), ("a", "4h", "bear", 4, 0.2), ("b", "1h", "bull", 6, 0.3)], "symbol string, timeframe string, type string, duration long, price_return double")
    got = {(r["level"], r["symbol"], r["timeframe"]): (r["zones"], r["mean_duration"]) for r in selection.batch_summary(f).collect()}
    assert got == {("symbol", "a", None): (2, 3.0), ("symbol", "b", None): (1, 6.0), ("timeframe", None, "1h"): (2, 4.0), ("timeframe", None, "4h"): (1, 4.0), ("all", None, None): (3, 4.0)}

import pytest
from pyspark.sql import functions as F

from tidewater.operators import cleaning, robustness, validation
from tidewater.sources import readers, writers
from tidewater.streaming.live import live_bars, live_zones

ROWS = "\n".join(f"2024-01-01 {h:02d}:00:00,1{h},2{h},0.{h},1{h},5" for h in range(10, 15))


def test_csv_with_header_aliases_and_encoding(spark, tmp_path):
    (tmp_path / "EURUSD_60.csv").write_bytes(("Time, O ,H,L,C,Vol\n" + ROWS).encode("utf-16"))
    d = readers.load_ohlcv(spark, str(tmp_path / "EURUSD_60.csv"))
    assert d.count() == 5 and d.first()["symbol"] == "EURUSD" and d.agg(F.max("close")).first()[0] == 114.0
    with pytest.raises(ValueError):
        readers.load_ohlcv(spark, str(tmp_path / "EURUSD_60.csv"), strict=True)


def test_headerless_and_directory(spark, tmp_path):
    (tmp_path / "XAUUSDM15.csv").write_text("2024.01.01 00:00,1,2,0.5,1,7,3\n2024.01.01 00:15,1,2,0.5,1.5,8,3\n")
    assert readers.headerless(spark, str(tmp_path / "XAUUSDM15.csv"))
    d = readers.load_directory(spark, str(tmp_path)).orderBy("bar_idx").collect()
    assert [r["bar_idx"] for r in d] == [0, 1] and d[1]["close"] == 1.5 and d[0]["symbol"] == "XAUUSD"


def test_file_names():
    assert readers.parse_file_name("OANDA_XAUUSD, 60.csv") == {"provider": "OANDA", "symbol": "XAUUSD", "timeframe": "1h"}
    assert readers.parse_file_name("eurusd_h4.csv")["timeframe"] == "4h"
    assert readers.parse_file_name("XAUUSDM15.csv")["symbol"] == "XAUUSD"


def test_bars_table_round_trip(spark, tmp_path):
    s = readers.Samples()
    assert s.find(symbol="xauusd", timeframe="15m") == ["xauusd_15m"] and s.preview(spark, "xauusd_1h").count() == 5
    b = s.load(spark, "xauusd_1h")
    assert b.where(~validation.valid_row()).count() == 0
    writers.write_bars(b, str(tmp_path / "bars"), "1h")
    back = readers.load_symbol(spark, str(tmp_path / "bars"), "XAUUSD", "60")
    assert back.count() == 1000 and "PartitionFilters: [isnotnull" in back._jdf.queryExecution().toString()
    assert [tuple(r) for r in readers.catalog(back).collect()] == [("XAUUSD", "1h")]


def test_flat_csv(spark, tmp_path):
    d = spark.sql("select 1 as a, named_struct('b', 2, 'c', array(1, 2)) as s")
    writers.save(d, str(tmp_path / "x"), "csv")
    assert spark.read.option("header", "true").csv(str(tmp_path / "x")).columns == ["a", "s.b", "s.c"]
    assert writers.to_records(d)[0]["s"] == {"b": 2, "c": [1, 2]}
    with pytest.raises(ValueError):
        writers.to_records(spark.range(5), most=3)


def test_validation_finds_faults(spark):
    rows = [("a", "2024-01-01 00:00:00", 0, 5.0, 4.0, 6.0, 5.0, -1.0), ("a", "2024-01-01 00:00:00", 1, 5.0, 6.0, 4.0, 5.0, 0.0), ("a", "2024-01-01 03:00:00", 2, None, 6.0, 4.0, -5.0, 0.0)]
    d = spark.createDataFrame(rows, "symbol string, ts string, bar_idx long, open double, high double, low double, close double, volume double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    found = {r["check"]: r["n"] for r in validation.validate(d).collect()}
    assert found == {"few_rows": 3, "high_below_low": 1, "duplicate_stamps": 2, "negative_volume": 1, "zero_volume": 2}
    fixed = cleaning.repair(d).orderBy("bar_idx").first()
    assert (fixed["high"], fixed["low"]) == (6.0, 4.0)
    assert cleaning.remove_outliers(d.withColumn("close", F.lit(1.0)), columns=("close",)).count() == 0  # no spread keeps nothing
    assert cleaning.clean(d.limit(0)).count() == 0


def test_simulations_are_repeatable(spark):
    b = readers.generated_sample(spark, bars=50)
    for how in ("shuffle_returns", "shuffle_prices", "gaussian"):
        one, two = (sorted(tuple(r) for r in robustness.simulate(b, 3, how=how).collect()) for _ in range(2))
        assert one == two and len(one) >= 3 * 49


def test_streams(spark, tmp_path):
    ticks = spark.sql("select 'a' as symbol, timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(id * 10 as int)) as ts, 100 + 5 * sin(id / 40.0) as price from range(1200)")
    ticks.write.parquet(str(tmp_path / "t"))
    stream = spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "t"))
    q = live_bars(stream, "symbol", "ts", "price").writeStream.format("memory").queryName("live_bars").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("select * from live_bars").toPandas()
    assert len(got) >= 150 and (got["high"] >= got["low"]).all()
    bars = spark.createDataFrame(got[["symbol", "ts", "close"]])
    bars.coalesce(1).write.parquet(str(tmp_path / "b"))
    q = live_zones(spark.readStream.schema(bars.schema).parquet(str(tmp_path / "b"))).writeStream.format("memory").queryName("live_zones").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    z = spark.sql("select * from live_zones").collect()
    assert len(z) > 2 and {r["type"] for r in z} == {"bull", "bear"}


def test_live_zones_end_and_leave_late_bars_out(spark, tmp_path):
    """A symbol that falls silent has its last zone; bars that come after later ones change nothing."""
    import pandas as pd

    def batch(k, symbol, first, closes):
        rows = pd.DataFrame({"symbol": symbol, "ts": pd.date_range("2024-01-01", periods=400, freq="h")[first : first + len(closes)], "close": closes})
        spark.createDataFrame(rows).coalesce(1).write.parquet(str(tmp_path / "in" / f"k{k}"))

    schema = "symbol string, ts timestamp, close double"
    parts = [("a", 0, [100.0 + i for i in range(20)]), ("a", 5, [1.0] * 10), ("b", 60, [50.0, 51.0]), ("b", 200, [52.0, 53.0]), ("b", 300, [52.0, 53.0])]
    q = None
    for k, part in enumerate(parts):
        batch(k, *part)
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        q = live_zones(stream, idle="30 hours").writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start(str(tmp_path / "out"))
        q.processAllAvailable()
        q.stop()
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).where("symbol = 'a'").select("type", "duration").collect()]
    assert got == [("bull", 20)]

"""Zones and bars by time: ranges, surroundings of a zone, nearest and as-of rows, summaries of many series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def zones_between(zones: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Zones that overlap [start, end]; an end that is None is open."""
    if start is not None:
        zones = zones.where(F.col("end_time") >= F.lit(start).cast("timestamp_ntz"))
    return zones.where(F.col("start_time") <= F.lit(end).cast("timestamp_ntz")) if end is not None else zones


def surroundings(bars: DataFrame, zones: DataFrame, context: int = 10, most: int | None = None, bin_bars: int = 1024) -> DataFrame:
    """Bars from context before each zone's start to context after its end, the last most of them; joined by
    (symbol, bin of bars)."""
    z = zones.select("symbol", "zone_id", "start_idx", "end_idx")
    z = z.withColumns({"__a": F.greatest(F.lit(0), F.col("start_idx") - context), "__e": F.col("end_idx") + context})
    z = z.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("__a") / bin_bars), F.floor(F.col("__e") / bin_bars))))
    b = bars.withColumn("__bin", F.floor(F.col("bar_idx") / bin_bars))
    hit = b.join(z, ["symbol", "__bin"]).where("bar_idx between __a and __e").drop("__bin", "__a", "__e")
    hit = hit.withColumn("in_zone", F.col("bar_idx").between(F.col("start_idx"), F.col("end_idx")))
    if most is not None:
        k = F.row_number().over(Window.partitionBy("symbol", "zone_id").orderBy(F.desc("bar_idx")))
        hit = hit.withColumn("__k", k).where(F.col("__k") <= most).drop("__k")
    return hit


def as_of(left: DataFrame, right: DataFrame, value: str, ts: str = "ts", key: str = "symbol") -> DataFrame:
    """left with the last value of right at or before each stamp: a union and one window, no range join."""
    both = left.select(key, ts, F.lit(None).cast(right.schema[value].dataType).alias("__v"), F.struct(*[F.col(c) for c in left.columns]).alias("__l"), F.lit(1).alias("__o"))
    both = both.unionByName(right.select(key, ts, F.col(value).alias("__v"), F.lit(0).alias("__o")), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(ts, "__o").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("__v", F.last("__v", ignorenulls=True).over(w)).where("__l is not null").select("__l.*", F.col("__v").alias(value))


def nearest_bar(bars: DataFrame, stamps: DataFrame, ts: str = "ts", key: str = "symbol") -> DataFrame:
    """(key, ts, bar_idx) of the bar nearest to each stamp, the earlier of equals: the bars before and after it."""
    at = F.unix_timestamp(F.col(ts).cast("timestamp"))
    both = bars.select(key, ts, F.struct(at.alias("t"), F.col("bar_idx").alias("i")).alias("b"), F.lit(0).alias("o")).unionByName(stamps.select(key, ts, F.lit(None).cast("struct<t: bigint, i: bigint>").alias("b"), F.lit(1).alias("o")))
    w = Window.partitionBy(key).orderBy(ts, "o")
    before, after = F.last("b", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first("b", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    s = both.withColumns({"p": before, "q": after}).where("o = 1")
    closer = F.when(F.col("q").isNull() | (at - F.col("p.t") <= F.col("q.t") - at), F.col("p.i")).otherwise(F.col("q.i"))
    return s.select(key, ts, F.coalesce(closer, F.col("q.i")).alias("bar_idx"))


def batch_summary(features: DataFrame, keys: tuple[str, ...] = ("symbol", "timeframe")) -> DataFrame:
    """Zones, mean duration and return for each key alone and for all rows: grouping sets in one pass."""
    sets = [[k] for k in keys] + [[]]
    a = features.groupingSets(sets, *keys).agg(F.count(F.lit(1)).alias("zones"), F.avg("duration").alias("mean_duration"), F.avg("price_return").alias("mean_return"), F.count_if(F.col("type") == "bull").alias("bull"), F.grouping_id(*keys).alias("g"))
    level = F.lit("all")
    for i, k in enumerate(keys):
        gid = sum(1 << (len(keys) - 1 - j) for j in range(len(keys)) if j != i)
        level = F.when(F.col("g") == gid, k).otherwise(level)
    return a.withColumn("level", level).drop("g")

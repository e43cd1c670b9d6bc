"""Segmentation of series into zones.

A detector labels bars and marks where a label ends; islands() numbers the runs and keeps those that are long
enough and of a wanted type. Everything is a window over the series or its runs: bars are read once and joined to
nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.series import by_bar, rolling


def islands(df: DataFrame, state: Column, label: Callable[[Window], Column], min_duration: int = 2, types: tuple[str, ...] | None = None, need_change: bool = False, missing_apart: bool = False) -> DataFrame:
    """Bars of kept zones with zone_id, type, start_idx, end_idx, duration.

    state: runs of equal values are zones; NULL runs as one zone, or each bar as its own (missing_apart). label: gives
    the type as a column, from a window over the bars of a run. need_change: a series of one run has no zone.
    zone_id numbers the kept zones of a series from 0."""
    w = by_bar()
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    run = Window.partitionBy("symbol", "__run").orderBy("bar_idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = df.withColumn("__state", state)
    before = F.lag("__state").over(w)
    new = ~F.col("__state").eqNullSafe(before)
    if missing_apart:
        new = new | F.col("__state").isNull()
    df = df.withColumn("__new", F.when(F.lag(F.lit(1)).over(w).isNull(), 1).otherwise(new.cast("int")))
    df = df.withColumn("__run", F.sum("__new").over(upto))
    if need_change:
        df = df.withColumn("__runs", F.max("__run").over(Window.partitionBy("symbol")))
    df = df.withColumns({
        "start_idx": F.first("bar_idx").over(run), "end_idx": F.last("bar_idx").over(run),
        "duration": F.count(F.lit(1)).over(run), "type": label(run),
    })
    kept = F.col("type").isNotNull() & (F.col("duration") >= min_duration)
    if types is not None:
        kept &= F.col("type").isin(*types)
    if need_change:
        kept &= F.col("__runs") > 1
    df = df.where(kept).withColumn("zone_id", (F.sum((F.col("bar_idx") == F.col("start_idx")).cast("int")).over(upto) - 1).cast("long"))
    return df.drop("__state", "__new", "__run", "__runs")


def zone_table(zoned: DataFrame) -> DataFrame:
    """One row for each zone of zoned bars."""
    return zoned.groupBy("symbol", "zone_id").agg(
        F.first("type").alias("type"), F.first("start_idx").alias("start_idx"), F.first("end_idx").alias("end_idx"), F.first("duration").alias("duration"), F.min("ts").alias("start_time"), F.max("ts").alias("end_time")
    )


def zero_crossing(df: DataFrame, indicator: str, smooth: int | None = None, min_duration: int = 2, types: tuple[str, ...] | None = ("bull", "bear")) -> DataFrame:
    """Runs of one sign of an indicator (zero counts as positive); a missing value stands alone. A series that never
    changes sign has no zone."""
    value = rolling(F.avg(indicator), indicator, smooth) if smooth and smooth > 1 else F.col(indicator)
    df = df.withColumn("__value", value)
    label = lambda run: F.when(F.avg("__value").over(run) > 0, "bull").otherwise("bear")
    return islands(df, F.col("__value") >= 0, label, min_duration, types, need_change=True, missing_apart=True).drop("__value")


def line_crossing(df: DataFrame, line1: str, line2: str, min_duration: int = 2, types: tuple[str, ...] | None = ("bull", "bear")) -> DataFrame:
    """Runs of one sign of line1 - line2, with the rules of zero_crossing."""
    df = zero_crossing(df.withColumn("__diff", F.col(line1) - F.col(line2)), "__diff", None, min_duration, types)
    return df.drop("__diff")


def threshold(df: DataFrame, indicator: str, upper: float, lower: float, min_duration: int = 2, types: tuple[str, ...] | None = ("overbought", "oversold", "neutral")) -> DataFrame:
    """Runs above upper, below lower, or between; a series of one kind is one zone."""
    if upper <= lower:
        raise ValueError("upper must be above lower")
    x = F.col(indicator)
    kind = F.when(x > upper, "overbought").when(x < lower, "oversold").when(x.isNotNull(), "neutral")
    return islands(df.withColumn("__kind", kind), F.col("__kind"), lambda run: F.col("__kind"), min_duration, types).drop("__kind")


def combined(df: DataFrame, conditions: list[str | Column], logic: str = "and", names: tuple[str, str] = ("active", "inactive"), min_duration: int = 2, types: tuple[str, ...] | None = None) -> DataFrame:
    """Runs of bars that do or do not meet conditions, given as SQL or columns; a missing condition is not met."""
    if not conditions or logic not in ("and", "or"):
        raise ValueError("conditions, and logic 'and' or 'or', are needed")
    parts = [F.coalesce(F.expr(c) if isinstance(c, str) else c, F.lit(False)) for c in conditions]
    met = parts[0]
    for p in parts[1:]:
        met = (met & p) if logic == "and" else (met | p)
    df = df.withColumn("__met", met)
    return islands(df, F.col("__met"), lambda run: F.when(F.col("__met"), names[0]).otherwise(names[1]), min_duration, types).drop("__met")


def preloaded_zones(df: DataFrame, zones: DataFrame, tolerance_seconds: int = 60, min_duration: int = 2, types: tuple[str, ...] | None = None, bin_seconds: int = 86_400) -> DataFrame:
    """Bars within external zones(symbol, zone_id, type, start_time, end_time), widened by a tolerance; zones may
    overlap. Both sides are cut into bins of time, so that this is a join on (symbol, bin) and a filter."""
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    sec = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    z = zones.select("symbol", F.col("zone_id").cast("long").alias("zone_id"), "type", (sec("start_time") - tolerance_seconds).alias("__lo"), (sec("end_time") + tolerance_seconds).alias("__hi")).where("__lo <= __hi")
    if types is not None and "any" not in types:
        z = z.where(F.col("type").isin(*types))
    z = z.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("__lo") / bin_seconds), F.floor(F.col("__hi") / bin_seconds))))
    b = df.withColumn("__at", at).withColumn("__bin", F.floor(F.col("__at") / bin_seconds))
    hit = b.join(z, ["symbol", "__bin"]).where("__at between __lo and __hi").drop("__bin", "__at", "__lo", "__hi")
    zone = Window.partitionBy("symbol", "zone_id")
    hit = hit.withColumns({"start_idx": F.min("bar_idx").over(zone), "end_idx": F.max("bar_idx").over(zone), "duration": F.count(F.lit(1)).over(zone)})
    return hit.where(F.col("duration") >= min_duration)


Detector = Callable[..., DataFrame]
_detectors: dict[str, tuple[Detector, tuple[str, ...], tuple[str, ...]]] = {
    "zero_crossing": (zero_crossing, ("indicator",), ("bull", "bear")),
    "line_crossing": (line_crossing, ("line1", "line2"), ("bull", "bear")),
    "threshold": (threshold, ("indicator", "upper", "lower"), ("overbought", "neutral", "oversold")),
    "combined": (combined, ("conditions",), ("active", "inactive")),
    "preloaded": (preloaded_zones, ("zones",), ("any",)),
}


def register_detector(name: str, function: Detector, required: tuple[str, ...] = (), supported: tuple[str, ...] = ()) -> None:
    _detectors[name] = (function, required, supported)


def detectors() -> dict[str, dict]:
    return {n: {"required": r, "types": s, "about": (f.__doc__ or "").split(".")[0]} for n, (f, r, s) in _detectors.items()}


def detect(df: DataFrame, strategy: str, **rules) -> DataFrame:
    """Zoned bars by a registered detector; its required rules must be there."""
    if strategy not in _detectors:
        raise ValueError(f"unknown detector {strategy}")
    function, required, _ = _detectors[strategy]
    if missing := [r for r in required if r not in rules]:
        raise ValueError(f"{strategy} needs {missing}")
    return function(df, **rules)

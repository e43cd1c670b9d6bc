"""Checks of bar tables; each is one aggregation, an anti-join or both, and returns rows, not prints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.series import OHLC, by_bar, corrected_kurtosis, corrected_skew

LEAST_ROWS, MOST_MISSING, MOST_ZERO_VOLUME, JUMP = 100, 0.1, 0.1, 0.5


def valid_row() -> Column:
    """The rules that a single bar must keep."""
    o, h, l, c, v = (F.col(x) for x in (*OHLC, "volume"))
    return (o > 0) & (h > 0) & (l > 0) & (c > 0) & (h >= l) & (h >= F.greatest(o, c)) & (l <= F.least(o, c)) & F.coalesce(v >= 0, F.lit(True))


def columns_present(columns: list[str], required: tuple[str, ...] = OHLC, optional: tuple[str, ...] = ("volume",)) -> dict:
    return {"missing": [c for c in required if c not in columns], "optional": [c for c in optional if c in columns], "extra": [c for c in columns if c not in (*required, *optional)]}


def completeness(df: DataFrame, columns: list[str], key: str = "symbol") -> DataFrame:
    """For each key: rows, share of missing values of each column, whether both are within limits."""
    shares = [(F.count_if(F.col(c).isNull()) / F.count(F.lit(1))).alias(f"{c}_missing") for c in columns]
    out = df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"), *shares)
    ok = F.col("n_rows") >= LEAST_ROWS
    for c in columns:
        ok &= F.col(f"{c}_missing") <= MOST_MISSING
    return out.withColumn("complete", ok)


def price_consistency(df: DataFrame, key: str = "symbol") -> DataFrame:
    """For each key the number of bars that break each rule."""
    df = df.withColumn("__jump", F.abs(F.try_divide(F.col("close"), F.lag("close").over(by_bar(key))) - 1))
    return df.groupBy(key).agg(
        F.count_if((F.col("open") <= 0) | (F.col("high") <= 0) | (F.col("low") <= 0) | (F.col("close") <= 0)).alias("not_positive"),
        F.count_if(F.col("high") < F.col("low")).alias("high_below_low"),
        F.count_if(F.col("high") < F.greatest("open", "close")).alias("high_below_body"),
        F.count_if(F.col("low") > F.least("open", "close")).alias("low_above_body"),
        F.count_if(F.col("__jump") > JUMP).alias("jumps"),
    )


def spacing(df: DataFrame, key: str = "symbol") -> DataFrame:
    """For each key: its commonest distance of stamps in seconds (the smallest of equals), duplicate stamps, and
    the number and share of other distances."""
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    steps = df.withColumn("__d", at - F.lag(at).over(Window.partitionBy(key).orderBy("ts")))
    each = steps.where("__d is not null").groupBy(key, "__d").agg(F.count(F.lit(1)).alias("n"))
    mode = each.groupBy(key).agg(F.min_by("__d", F.struct(-F.col("n"), F.col("__d"))).alias("step_seconds"), F.max("n").alias("regular"), F.sum("n").alias("steps"), F.sum(F.when(F.col("__d") == 0, F.col("n")).otherwise(0)).alias("duplicates"))
    return mode.select(key, "step_seconds", "duplicates", (F.col("steps") - F.col("regular")).alias("irregular"), ((F.col("steps") - F.col("regular")) / F.col("steps") > 0.1).alias("is_irregular"))


def missing_bars(df: DataFrame, step: str = "1 hour", key: str = "symbol") -> DataFrame:
    """(key, ts) of the stamps between a series' first and last that it lacks: an anti-join on (key, ts)."""
    ends = df.groupBy(key).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    every = ends.select(key, F.explode(F.sequence("lo", "hi", F.expr(f"interval {step}"))).alias("ts"))
    return every.join(df.select(key, "ts"), [key, "ts"], "left_anti")


def gaps(df: DataFrame, factor: float = 1.5, key: str = "symbol") -> DataFrame:
    """Distances above factor times the series' median distance."""
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    steps = df.withColumn("gap_seconds", at - F.lag(at).over(Window.partitionBy(key).orderBy("ts"))).where("gap_seconds is not null")
    middle = steps.groupBy(key).agg(F.median("gap_seconds").alias("median_seconds"))
    return steps.join(middle, key).where(F.col("gap_seconds") > factor * F.col("median_seconds")).select(key, "bar_idx", "gap_seconds", "median_seconds")


def statistical_properties(df: DataFrame, columns: list[str], key: str = "symbol") -> DataFrame:
    """For each key and column: moments, outliers beyond 1.5 quartile ranges, flags of skewness, kurtosis, outliers."""
    rows = df.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])).alias("s")).select(key, "s.*")
    n = F.count("x")
    out = rows.groupBy(key, "column").agg(n.alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"), corrected_skew("x", n).alias("skew"), corrected_kurtosis("x", n).alias("kurtosis"), F.percentile("x", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    lo, hi = F.col("q")[0], F.col("q")[1]
    edges = out.select(key, "column", (lo - 1.5 * (hi - lo)).alias("lo"), (hi + 1.5 * (hi - lo)).alias("hi"))
    outside = rows.join(edges, [key, "column"]).groupBy(key, "column").agg(F.count_if((F.col("x") < F.col("lo")) | (F.col("x") > F.col("hi"))).alias("outliers"))
    out = out.drop("q").join(outside, [key, "column"])
    return out.withColumns({"is_skewed": F.abs("skew") > 2, "is_heavy": F.abs("kurtosis") > 7, "has_outliers": F.col("outliers") / F.col("n") > 0.05})


def validate(df: DataFrame, strict: bool = False, key: str = "symbol") -> DataFrame:
    """(key, check, severity, n): what is wrong with each series; an issue, or a warning unless strict."""
    w = Window.partitionBy(key).orderBy("bar_idx")
    df = df.withColumns({"__before": F.lag("ts").over(w), "__copies": F.count(F.lit(1)).over(Window.partitionBy(key, "ts"))})
    cells = sum((F.count_if(F.col(c).isNull()) for c in OHLC), F.lit(0))
    a = df.groupBy(key).agg(
        F.when(F.count(F.lit(1)) < LEAST_ROWS, F.count(F.lit(1))).alias("few_rows"),
        F.when(cells / (4 * F.count(F.lit(1))) > MOST_MISSING, cells).alias("missing_values"),
        F.count_if(F.col("high") < F.col("low")).alias("high_below_low"),
        F.count_if(F.col("ts") < F.col("__before")).alias("not_ordered"),
        F.count_if(F.col("__copies") > 1).alias("duplicate_stamps"),
        F.count_if(F.col("volume") < 0).alias("negative_volume"),
        F.when(F.count_if(F.col("volume") == 0) / F.count(F.lit(1)) > MOST_ZERO_VOLUME, F.count_if(F.col("volume") == 0)).alias("zero_volume"),
    )
    soft = {"missing_values", "duplicate_stamps", "zero_volume", "few_rows"}
    names = [c for c in a.columns if c != key]
    rows = a.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.lit("warning" if c in soft and not strict else "issue").alias("severity"), F.col(c).cast("long").alias("n")) for c in names])).alias("s"))
    return rows.select(key, "s.*").where("n > 0")


def require(df: DataFrame, required: tuple[str, ...] = OHLC, strict: bool = False, key: str = "symbol") -> DataFrame:
    """df itself, or ValueError with all that is wrong: columns that are missing, no rows, issues that validate() finds."""
    if missing := columns_present(df.columns, required)["missing"]:
        raise ValueError(f"columns missing: {missing}")
    if df.isEmpty():
        raise ValueError("no rows")
    found = validate(df, strict, key).where("severity = 'issue'").groupBy("check").agg(F.sum("n").alias("n")).collect()
    if found:
        raise ValueError("; ".join(sorted(f"{r['check']}: {r['n']}" for r in found)))
    return df


def usable(df: DataFrame, columns: tuple[str, ...] = ()) -> bool:
    """Whether an analysis can begin: the columns are there and there is a row."""
    return not [c for c in columns if c not in df.columns] and not df.isEmpty()

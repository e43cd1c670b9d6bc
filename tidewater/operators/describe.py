"""Descriptive statistics, correlations, distributions of zones."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.distributions import chi2_sf, normal_sf, t_two_sided
from tidewater.functions.series import corrected_kurtosis, corrected_skew, correlation


def long_form(df: DataFrame, columns: list[str], key: list[str]) -> DataFrame:
    """(key, column, x): a row for each value."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])
    return df.select(*key, F.explode(cells).alias("s")).select(*key, "s.*")


def describe(df: DataFrame, columns: list[str], key: list[str] | None = None) -> DataFrame:
    """Rows, moments, extremes, quartiles, bias-corrected shape, coefficient of variation of each key and column."""
    key = key or []
    n = F.count("x")
    q = F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    a = long_form(df, columns, key).groupBy(*key, "column").agg(
        F.count(F.lit(1)).alias("count"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"), q.alias("q"),
        corrected_skew("x", n).alias("skewness"), corrected_kurtosis("x", n).alias("kurtosis"), F.var_samp("x").alias("variance"),
    )
    a = a.withColumns({"q25": F.col("q")[0], "median": F.col("q")[1], "q75": F.col("q")[2], "cv": F.try_divide(F.col("std"), F.abs("mean"))})
    return a.drop("q")


def correlation_matrix(df: DataFrame, columns: list[str], key: list[str] | None = None) -> DataFrame:
    """(key, a, b, r): Pearson over the rows where both are there, for each pair of columns; one aggregation."""
    key = key or []
    pairs = [*combinations(columns, 2)]
    agg = df.groupBy(*key).agg(*[correlation(a, b).alias(f"r{k}") for k, (a, b) in enumerate(pairs)])
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(pairs)])
    return agg.select(*key, F.explode(cells).alias("s")).select(*key, "s.*")


def ranked(df: DataFrame, column: str, out: str, key: list[str]) -> DataFrame:
    """Average ranks, ties sharing theirs."""
    w = Window.partitionBy(*key)
    first = F.rank().over(w.orderBy(column))
    same = F.count(F.lit(1)).over(Window.partitionBy(*key, column))
    return df.withColumn(out, first + (same - 1) / 2.0)


def spearman(df: DataFrame, a: str, b: str, key: list[str]) -> DataFrame:
    some = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*key, a, b)
    some = ranked(ranked(some, a, "__ra", key), b, "__rb", key)
    return some.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), correlation("__ra", "__rb").alias("rho"))


def inversions(x: np.ndarray) -> int:
    """Pairs of places in order whose values are not: a merge sort from below, all blocks of a level at once."""
    _, x = np.unique(x, return_inverse=True)
    n, total, width, spread = len(x), 0, 1, int(len(x)) + 1
    block = np.arange(n)
    while width < n:
        # within a pair of blocks both halves are sorted; those of the left above each of the right
        pair = block // (2 * width)
        right = block // width % 2 == 1
        key = pair * spread + x
        left = key[~right]
        higher = np.searchsorted(left, (pair[right] + 1) * spread) - np.searchsorted(left, key[right], side="right")
        total += int(higher.sum())
        x = x[np.argsort(key, kind="stable")]
        width *= 2
    return total


def kendall(df: DataFrame, a: str, b: str, key: list[str]) -> DataFrame:
    """Kendall's tau-b of each key: n, tau, z and p_value (normal, with the usual correction for ties). A key's pairs of
    values, 16 bytes each, are sorted in one task; discordant pairs are counted by merging, never listed."""
    some = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*key, F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    kinds = [df.schema[k] for k in key]

    def run(rows: pa.Table) -> pa.Table:
        x, y = rows.column("a").to_numpy(), rows.column("b").to_numpy()
        order = np.lexsort((y, x))
        x, y, n = x[order], y[order], len(x)
        ties = lambda *columns: np.unique(np.column_stack(columns), axis=0, return_counts=True)[1].astype(float)
        tx, ty, both = ties(x), ties(y), ties(x, y)
        pairs = lambda t: float((t * (t - 1) / 2).sum())
        all_ = n * (n - 1) / 2
        # within equal x the y rise, so inversions are the discordant pairs
        s = all_ - pairs(tx) - pairs(ty) + pairs(both) - 2 * inversions(y)
        scale = math.sqrt((all_ - pairs(tx)) * (all_ - pairs(ty)))
        m = n * (n - 1.0)
        f = lambda t, g: float(g(t).sum())
        v = (m * (2 * n + 5) - f(tx, lambda t: t * (t - 1) * (2 * t + 5)) - f(ty, lambda t: t * (t - 1) * (2 * t + 5))) / 18
        if n > 2:
            v += f(tx, lambda t: t * (t - 1)) * f(ty, lambda t: t * (t - 1)) / (2 * m) + f(tx, lambda t: t * (t - 1) * (t - 2)) * f(ty, lambda t: t * (t - 1) * (t - 2)) / (9 * m * (n - 2))
        z = s / math.sqrt(v) if n > 1 and v > 0 else None
        values = [*(rows.column(k)[0].as_py() for k in key), n, s / scale if scale else None, z, None if z is None else min(1.0, 2 * normal_sf(abs(z)))]
        return pa.table([[v] for v in values], schema=pa.schema([*(rows.schema.field(k) for k in key), ("n", pa.int64()), ("tau", pa.float64()), ("z", pa.float64()), ("p_value", pa.float64())]))

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds), "n long, tau double, z double, p_value double"])
    return some.groupBy(*key).applyInArrow(run, schema)


def with_p_values(df: DataFrame, kind: str, statistic: str, n: str | None = None, out: str = "p_value") -> DataFrame:
    """A table of results, one row a test, with the two-sided p of its statistic: kind 'normal' (a z), 'chi2' (n: degrees of
    freedom), 'pearson' (a correlation of n pairs, by Student's t)."""

    def p(x: float | None, k: float | None) -> float | None:
        if x is None or (k is None and kind != "normal"):
            return None
        if kind == "normal":
            return min(1.0, 2 * normal_sf(abs(x)))
        if kind == "chi2":
            return chi2_sf(x, k)
        if k < 3:
            return None
        return 0.0 if abs(x) >= 1 else t_two_sided(x * math.sqrt((k - 2) / (1 - x * x)), k - 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ks = b.column(n).to_pylist() if n else [None] * len(b)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([*map(p, b.column(statistic).to_pylist(), ks)], pa.float64())], names=[*b.schema.names, out])

    if kind not in ("normal", "chi2", "pearson"):
        raise ValueError(f"unknown kind {kind}")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"{out} double"])
    return df.mapInArrow(run, schema)


def correlation_tests(df: DataFrame, a: str, b: str, key: list[str]) -> DataFrame:
    """(key, method, r, n, p_value, significant): Pearson, Spearman and Kendall of each key."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    one = df.where(both).groupBy(*key).agg(correlation(a, b).alias("r"), F.count(F.lit(1)).alias("n"))
    two = spearman(df, a, b, key).withColumnRenamed("rho", "r")
    by_t = [with_p_values(t.select(*key, F.lit(m).alias("method"), "r", "n"), "pearson", "r", "n") for m, t in (("pearson", one), ("spearman", two))]
    three = kendall(df, a, b, key).select(*key, F.lit("kendall").alias("method"), F.col("tau").alias("r"), "n", "p_value")
    return by_t[0].unionByName(by_t[1]).unionByName(three).withColumn("significant", F.coalesce(F.col("p_value") < 0.05, F.lit(False)))


def zone_distribution(features: DataFrame, columns: tuple[str, ...] = ("duration", "price_return", "macd_amplitude", "hist_amplitude")) -> DataFrame:
    """Figures of each feature over all zones and for each type: grouping sets in one pass."""
    rows = long_form(features, [*columns], ["type"])
    a = rows.groupingSets([["column"], ["column", "type"]], "column", "type").agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"), F.median("x").alias("median"), F.grouping("type").alias("g")
    )
    return a.withColumn("type", F.when(F.col("g") == 1, "all").otherwise(F.col("type"))).drop("g")


def zone_summary(features: DataFrame) -> DataFrame:
    """One row a type: zones, mean duration and return, gains and losses, correlation signs, peaks and troughs."""
    r = F.col("correlation_price_hist")
    return features.groupBy("type").agg(
        F.count(F.lit(1)).alias("zones"), F.avg("duration").alias("mean_duration"), F.avg("price_return").alias("mean_return"), F.count_if(F.col("price_return") > 0).alias("gains"), F.count_if(F.col("price_return") < 0).alias("losses"),
        F.count_if(r > 0).alias("positive_corr"), F.count_if(r < 0).alias("negative_corr"), F.count_if(F.abs(r) > 0.7).alias("strong_corr"),
    )


def histogram(df: DataFrame, column: str, bins: int = 20, key: str = "symbol") -> DataFrame:
    """Counts in equal bins between each key's extremes; the largest value is in the last bin."""
    ends = df.groupBy(key).agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    at = F.least(F.width_bucket(F.col(column), F.col("lo"), F.col("hi"), F.lit(bins)), F.lit(bins))
    return df.where(F.col(column).isNotNull()).join(ends, key).withColumn("bin", F.when(F.col("lo") == F.col("hi"), 1).otherwise(at)).groupBy(key, "bin").agg(F.count(F.lit(1)).alias("n"))


def linear_trend(df: DataFrame, column: str, key: str = "symbol") -> DataFrame:
    return df.groupBy(key).agg(F.regr_slope(column, "bar_idx").alias("slope"), F.regr_intercept(column, "bar_idx").alias("intercept"), F.regr_r2(column, "bar_idx").alias("r2"))


def table_info(df: DataFrame, key: str = "symbol") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), *[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in ("open", "high", "low", "close", "volume")])

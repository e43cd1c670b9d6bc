"""Exponentially weighted means as window sums.

With r = 1 - alpha the weighted sum of a series is N(t) = sum of r^(t-i) x(i). Within a chunk of rows this is
r^p times the running sum of x / r^p with p the place in the chunk, where chunks are so short that r^p stays a
normal double. What came before a chunk enters through the sum at the end of the chunk before it; anything older
weighs less than 1e-200. So a series of any length takes two passes of plain window sums over the
partitioning by symbol that all other windows use: no Python, no recursion and no series held as an array."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.series import INDEX, SYMBOL

#: Natural logarithm of the smallest weight within a chunk.
SPAN = 480.0


def chunk_rows(alpha: float) -> int:
    return max(1, min(1 << 20, int(SPAN / -math.log1p(-alpha)))) if alpha < 1 else 1 << 20


def alpha_of(span: float | None = None, alpha: float | None = None) -> float:
    a = alpha if alpha is not None else 2.0 / (span + 1.0)
    if not 0 < a <= 1:
        raise ValueError("alpha must be in (0, 1]")
    return a


def ewm_mean(df: DataFrame, out: dict[str, tuple[str | Column, float, bool]], symbol: str = SYMBOL, order: str = INDEX) -> DataFrame:
    """df with a column for each entry of out: name -> (value, alpha, adjust).

    adjust=True: weighted mean with weights r^(t-i); missing values have no weight but let older ones decay, and a row
    with a missing value repeats the mean. adjust=False: e(t) = alpha x(t) + r e(t-1) from the first value on;
    missing values are passed over. NULL until the first value. order must number the rows of a series 0, 1, 2, ..."""
    own, kinds = list(df.columns), {}
    for name, (value, alpha, adjust) in out.items():
        df = df.withColumn(f"__x_{name}", (F.col(value) if isinstance(value, str) else value).cast("double"))
        kinds.setdefault("shared" if adjust else name, []).append((name, alpha, adjust))
    for group in kinds.values():
        df = _grouped(df, group, symbol, order)
    return df.select(*own, *out)


def _grouped(df: DataFrame, group: list[tuple[str, float, bool]], symbol: str, order: str) -> DataFrame:
    """Columns of one group share their chunks, and so the windows; a group has adjusted means, or one that is not."""
    whole = Window.partitionBy(symbol).orderBy(order)
    upto = whole.rowsBetween(Window.unboundedPreceding, 0)
    rows = min(chunk_rows(alpha) for _, alpha, _ in group)
    adjust, first = group[0][2], f"__x_{group[0][0]}"
    # not adjusted: the place among the values that are there
    i = F.col(order).cast("long") if adjust else F.sum(F.col(first).isNotNull().cast("long")).over(upto) - 1
    df = df.withColumn("__i", i)
    df = df.withColumns({"__c": F.floor(F.col("__i") / rows), "__p": F.pmod(F.col("__i"), F.lit(rows)).cast("double")})
    chunk = Window.partitionBy(symbol, "__c").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    sums, ends, done = {}, [], {}
    for name, alpha, _ in group:
        x, r = F.col(f"__x_{name}"), 1.0 - alpha
        there = x.isNotNull().cast("double")
        weight = there if adjust else there * F.when(F.col("__i") == 0, F.lit(1.0)).otherwise(F.lit(alpha))
        scale = F.pow(F.lit(r), -F.col("__p")) if r > 0 else F.lit(1.0)
        down = F.pow(F.lit(r), F.col("__p")) if r > 0 else F.lit(1.0)
        sums[f"__n_{name}"] = F.sum(F.coalesce(x, F.lit(0.0)) * weight * scale).over(chunk) * down
        if adjust:
            sums[f"__d_{name}"] = F.sum(weight * scale).over(chunk) * down
        sums[f"__s_{name}"] = F.last(x, ignorenulls=True).over(upto)
        ends += [F.col(f"__n_{name}").alias(f"n_{name}"), *([F.col(f"__d_{name}").alias(f"d_{name}")] if adjust else [])]
        fade = down * r
        n = F.col(f"__n_{name}") + F.coalesce(F.col(f"__b.n_{name}") * fade, F.lit(0.0))
        d = F.col(f"__d_{name}") + F.coalesce(F.col(f"__b.d_{name}") * fade, F.lit(0.0)) if adjust else F.lit(1.0)
        # nothing before the first value; alpha = 1 is the last value itself
        done[name] = F.when(F.col(f"__s_{name}").isNotNull(), n / d) if r > 0 else F.col(f"__s_{name}")
    df = df.withColumns(sums)
    # rows are numbered, so the last row of a full chunk is known by its place
    full = F.when(F.col("__p") == rows - 1, F.struct(*ends))
    df = df.withColumn("__e", full).withColumn("__b", F.last("__e", ignorenulls=True).over(whole.rowsBetween(Window.unboundedPreceding, -1)))
    return df.withColumns(done).drop("__i", "__c", "__p", "__e", "__b", *sums)

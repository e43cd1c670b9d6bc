"""Column helpers for ordered series. Every window is partitioned by the series key, so one exchange and one sort
on (symbol, bar_idx) serve all of them; in_chunks() lets them run over pieces of a series, each a task of its own. Missing
values are NULL; NaN is turned into NULL where data enter."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SYMBOL, INDEX = "symbol", "bar_idx"
OHLC = ("open", "high", "low", "close")


def by_bar(symbol: str = SYMBOL, order: str = INDEX) -> Window:
    return Window.partitionBy(symbol).orderBy(order)


def lag(name: str, n: int = 1) -> Column:
    return F.lag(name, n).over(by_bar())


def rolling(expr: Column, over: str | Column, n: int) -> Column:
    """An aggregate of the last n rows, NULL until n values are there (min_periods = n)."""
    w = by_bar().rowsBetween(-(n - 1), 0)
    value = F.col(over) if isinstance(over, str) else over
    return F.when(F.count(value).over(w) == n, expr.over(w))


def quotient(a: Column, b: Column, ieee: bool = False) -> Column:
    """a / b in double precision; by zero it is NULL or, if ieee, what SQL's doubles give: an infinity with its sign, NaN for 0 / 0."""
    a, b = a.cast("double"), b.cast("double")
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(F.try_divide(a, b)) if ieee else F.try_divide(a, b)


def change(name: str, n: int = 1, ieee: bool = False) -> Column:
    """Relative change to the value n rows before; NULL where that is missing or, unless ieee, zero."""
    return quotient(F.col(name), lag(name, n), ieee) - 1


def no_nan(df: DataFrame) -> DataFrame:
    """NaN to NULL in all floating columns."""
    floats = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    return df.select(*[F.nullif(F.col(c), F.lit(float("nan"))).alias(c) if c in floats else F.col(c) for c in df.columns])


def corrected_skew(x: str | Column, n: Column) -> Column:
    """Bias-corrected sample skewness; NULL below three values."""
    g = F.skewness(x)
    return F.when(n > 2, g * F.sqrt(n * (n - 1)) / (n - 2))


def corrected_kurtosis(x: str | Column, n: Column) -> Column:
    """Bias-corrected excess kurtosis; NULL below four values."""
    g = F.kurtosis(x)
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g + 6))


def correlation(a: str | Column, b: str | Column, ieee: bool = False) -> Column:
    """Pearson over the rows where both are there; NULL (NaN if ieee) where one of them is constant."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    return quotient(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b), ieee)


def in_chunks(df: DataFrame, apply: Callable[[DataFrame], DataFrame], before: int, rows: int = 1 << 18) -> DataFrame:
    """What apply, made of windows that look back at most before rows, gives for bars numbered by bar_idx from 0 on; a series is
    cut into chunks of rows, and each gets the before rows that precede it. So a series of any length is spread over as
    many tasks as it has chunks, for one exchange and before / rows more rows."""
    if before > rows:
        raise ValueError("chunks must not be shorter than what windows look back at")
    own, at = F.floor(F.col(INDEX) / rows), F.pmod(F.col(INDEX), F.lit(rows))
    places = F.when(at >= rows - before, F.array(own, own + 1)).otherwise(F.array(own))
    wide = df.withColumns({"__series": F.col(SYMBOL), "__own": own}).withColumn("__chunk", F.explode(places))
    wide = wide.withColumn(SYMBOL, F.struct("__series", "__chunk"))
    out = apply(wide).where(F.col("__own") == F.col("__chunk"))
    return out.withColumn(SYMBOL, F.col("__series")).drop("__series", "__own", "__chunk")

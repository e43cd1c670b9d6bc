"""Indicators and their registry. Each takes bars and returns them with its columns added."""

from __future__ import annotations

import importlib
import inspect
import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions.ewm import alpha_of, ewm_mean
from tidewater.functions.series import in_chunks, lag, rolling


def sma(df: DataFrame, period: int = 20, column: str = "close", out: str | None = None) -> DataFrame:
    return df.withColumn(out or f"sma_{period}", rolling(F.avg(column), column, period))


def ema(df: DataFrame, period: int = 20, column: str = "close", adjust: bool = False, out: str | None = None) -> DataFrame:
    return ewm_mean(df, {out or f"ema_{period}": (column, alpha_of(span=period), adjust)})


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, column: str = "close", adjust: bool = True) -> DataFrame:
    """macd, macd_signal, macd_hist."""
    df = ewm_mean(df, {"__fast": (column, alpha_of(span=fast), adjust), "__slow": (column, alpha_of(span=slow), adjust)})
    df = df.withColumn("macd", F.col("__fast") - F.col("__slow")).drop("__fast", "__slow")
    df = ewm_mean(df, {"macd_signal": ("macd", alpha_of(span=signal), adjust)})
    return df.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))


def rsi(df: DataFrame, period: int = 14, column: str = "close", adjust: bool = True, out: str | None = None) -> DataFrame:
    """100 - 100 / (1 + mean gain / mean loss); the first bar has none, and no loss with some gain is 100."""
    step = F.col(column) - lag(column)
    df = df.withColumns({"__gain": F.coalesce(F.greatest(step, F.lit(0.0)), F.lit(0.0)), "__loss": F.coalesce(F.greatest(-step, F.lit(0.0)), F.lit(0.0))})
    a = alpha_of(alpha=1.0 / period)
    df = ewm_mean(df, {"__up": ("__gain", a, adjust), "__down": ("__loss", a, adjust)})
    up, down = F.col("__up"), F.col("__down")
    value = F.when((up == 0) & (down == 0), F.lit(None)).when(down == 0, F.lit(100.0)).otherwise(100 - 100 / (1 + F.try_divide(up, down)))
    return df.withColumn(out or f"rsi_{period}", value).drop("__gain", "__loss", "__up", "__down")


def bollinger(df: DataFrame, period: int = 20, std_dev: float = 2.0, column: str = "close", population: bool = False) -> DataFrame:
    """bb_middle, bb_upper, bb_lower, bb_width (percent of the middle), bb_percent."""
    std = F.stddev_pop(column) if population else F.stddev_samp(column)
    df = df.withColumns({"bb_middle": rolling(F.avg(column), column, period), "__s": rolling(std, column, period)})
    df = df.withColumns({"bb_upper": F.col("bb_middle") + std_dev * F.col("__s"), "bb_lower": F.col("bb_middle") - std_dev * F.col("__s")})
    width = F.col("bb_upper") - F.col("bb_lower")
    return df.withColumns({"bb_width": F.try_divide(width, F.col("bb_middle")) * 100, "bb_percent": F.try_divide(F.col(column) - F.col("bb_lower"), width) * 100}).drop("__s")


def awesome(df: DataFrame, fast: int = 5, slow: int = 34, out: str | None = None) -> DataFrame:
    df = df.withColumn("__mid", (F.col("high") + F.col("low")) / 2)
    return df.withColumn(out or f"ao_{fast}_{slow}", rolling(F.avg("__mid"), "__mid", fast) - rolling(F.avg("__mid"), "__mid", slow)).drop("__mid")


def atr(df: DataFrame, period: int = 14) -> DataFrame:
    from tidewater.operators.derived import full_true_range

    df = df.withColumn("__tr", full_true_range())
    return df.withColumn("atr", rolling(F.avg("__tr"), "__tr", period)).drop("__tr")


def moving_averages(df: DataFrame, periods: tuple[int, ...] = (10, 20, 50, 200), column: str = "close") -> DataFrame:
    """sma_p and ema_p (weights adjusted) of each period."""
    for p in periods:
        df = sma(df, p, column)
    return ewm_mean(df, {f"ema_{p}": (column, alpha_of(span=p), True) for p in periods})


def suite(df: DataFrame) -> DataFrame:
    """The usual set: two averages, ema 12 and 26, rsi 14, macd, bands of 20."""
    df = ewm_mean(sma(sma(df, 20), 50), {"ema_12": ("close", alpha_of(span=12), False), "ema_26": ("close", alpha_of(span=26), True)})
    return bollinger(macd(rsi(df)))


def preloaded(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Columns that the data already hold, under new names; they must be numeric."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    for c in columns:
        if c not in kinds:
            raise ValueError(f"no such column: {c}")
        if kinds[c] not in ("double", "float", "integer", "long", "short", "byte") and not kinds[c].startswith("decimal"):
            raise ValueError(f"{c} is not numeric")
    return df.withColumns({new: F.col(c) for c, new in columns.items()})


def preloaded_macd(df: DataFrame, macd: str = "macd", signal: str = "signal") -> DataFrame:
    """A MACD and its signal line that the data already hold, as macd, macd_signal and their difference macd_hist."""
    df = preloaded(df, {macd: "macd", signal: "macd_signal"})
    return df.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))


def statistics(df: DataFrame, columns: list[str], key: str = "symbol") -> DataFrame:
    """(key, column): values, missing, min, max, mean, std, median of each column."""
    rows = df.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])).alias("s")).select(key, "s.*")
    return rows.groupBy(key, "column").agg(F.count("x").alias("n"), F.count_if(F.col("x").isNull()).alias("missing"), F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.median("x").alias("median"))


Indicator = Callable[..., DataFrame]
_sources: dict[str, dict[str, Indicator]] = {
    "custom": {"sma": sma, "ema": ema, "macd": macd, "rsi": rsi, "bbands": bollinger, "ao": awesome, "atr": atr, "moving_averages": moving_averages, "suite": suite},
    "preloaded": {"columns": preloaded, "macd": preloaded_macd},
    "library": {},
    # the same indicators by the names and defaults of two common libraries, without them
    "talib": {
        "sma": lambda df, timeperiod=30: sma(df, timeperiod), "ema": lambda df, timeperiod=30: ema(df, timeperiod), "rsi": lambda df, timeperiod=14: rsi(df, timeperiod),
        "macd": lambda df, fastperiod=12, slowperiod=26, signalperiod=9: macd(df, fastperiod, slowperiod, signalperiod), "bbands": lambda df, timeperiod=5, nbdevup=2.0: bollinger(df, timeperiod, nbdevup),
    },
    "pandas_ta": {
        "rsi": lambda df, length=14: rsi(df, length, out=f"RSI_{length}"), "ao": lambda df, fast=5, slow=34: awesome(df, fast, slow, out=f"AO_{fast}_{slow}"),
        "sma": lambda df, length=10: sma(df, length, out=f"SMA_{length}"), "ema": lambda df, length=10: ema(df, length, out=f"EMA_{length}"), "bbands": lambda df, length=5, std=2.0: bollinger(df, length, std),
    },
}


def register(name: str, function: Indicator, source: str = "custom") -> None:
    """Adds an indicator: a function of bars and parameters that returns bars with columns added."""
    _sources.setdefault(source, {})[name] = function


def available() -> dict[str, list[str]]:
    return {s: sorted(names) for s, names in _sources.items()}


def _fades(alpha: float) -> int:
    """Rows after which a weight is below the last digit of a double."""
    return math.ceil(40 / -math.log1p(-alpha)) if alpha < 1 else 1


#: Rows that an indicator looks back at; weighted means fade.
LOOKS_BACK: dict[str, Callable[..., int]] = {
    "sma": lambda period=20, **_: period, "ema": lambda period=20, **_: _fades(alpha_of(span=period)), "bbands": lambda period=20, **_: period,
    "rsi": lambda period=14, **_: _fades(1 / period) + 1, "macd": lambda fast=12, slow=26, signal=9, **_: _fades(alpha_of(span=max(fast, slow))) + _fades(alpha_of(span=signal)),
    "ao": lambda slow=34, **_: slow, "atr": lambda period=14, **_: period + 1,
    "moving_averages": lambda periods=(10, 20, 50, 200), **_: _fades(alpha_of(span=max(periods))), "suite": lambda **_: 1000,
}


def create(source: str, name: str, chunk_rows: int | None = None, **parameters) -> Callable[[DataFrame], DataFrame]:
    """A registered indicator with its parameters, ready to be applied to bars. With chunk_rows, series are cut into chunks of so
    many bars that are tasks of their own; it must be known how far the indicator looks back."""
    try:
        function = _sources[source][name]
    except KeyError:
        raise ValueError(f"unknown indicator {source}/{name}") from None
    if chunk_rows is None:
        return lambda df: function(df, **parameters)
    if name not in LOOKS_BACK or _sources[source][name] is not _sources["custom"].get(name):
        raise ValueError(f"it is not known how far {source}/{name} looks back")
    return lambda df: in_chunks(df, lambda d: function(d, **parameters), LOOKS_BACK[name](**parameters), chunk_rows)


#: Bars that an indicator needs with its usual parameters' names.
LEAST_BARS: dict[str, Callable[..., int]] = {
    "sma": lambda period=20, **_: period, "ema": lambda period=20, **_: period, "bbands": lambda period=20, **_: period,
    "rsi": lambda period=14, **_: period + 1, "macd": lambda slow=26, signal=9, **_: slow + signal, "ao": lambda slow=34, **_: slow, "atr": lambda period=14, **_: period + 1,
}


def least_bars(name: str, **parameters) -> int:
    """Bars that a series needs for an indicator to mean anything; one where nothing is known."""
    return LEAST_BARS.get(name, lambda **_: 1)(**parameters)


def too_short(df: DataFrame, name: str, key: str = "symbol", **parameters) -> DataFrame:
    """(key, n, needed) of the series with fewer bars than an indicator needs."""
    need = least_bars(name, **parameters)
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < need).withColumn("needed", F.lit(need).cast("long"))


#: Numeric columns that are no oscillator.
PLAIN = ("open", "high", "low", "close", "volume", "time", "timestamp", "date", "datetime", "atr", "true_range", "tr", "index", "id", "zone_id", "bar_idx")


def find_oscillator(df: DataFrame) -> str | None:
    """The first numeric column that is neither a price nor an auxiliary one."""
    numeric = ("double", "float", "integer", "long", "short", "byte")
    return next((f.name for f in df.schema.fields if f.dataType.typeName() in numeric and f.name.lower() not in PLAIN), None)


def combined(df: DataFrame, indicators: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Bars with the columns of several indicators; a column that bars or an earlier indicator have is prefixed by the name."""
    own = df.columns
    for name, function in indicators.items():
        bare = function(df.select(*own))
        new = [c for c in bare.columns if c not in own]
        clash = {c: f"{name}_{c}" if c in df.columns else c for c in new}
        held = [c for c in df.columns if c not in own]
        # computed beside what is there already: names that clash step aside while the function runs
        moved = df.withColumnsRenamed({c: f"__held_{c}" for c in held})
        df = function(moved).withColumnsRenamed(clash).withColumnsRenamed({f"__held_{c}": c for c in held})
    return df


def register_library(module: str, names: list[str] | None = None, source: str = "library") -> list[str]:
    """Registers functions of an installed library that take price series (arguments named open, high, low, close,
    volume) and return a series or a frame; returns their names, none where the library is not installed. Each runs on
    one series' pandas frame."""
    try:
        library = importlib.import_module(module)
    except ImportError:
        return []
    found = []
    for name in names or sorted(n for n in dir(library) if not n.startswith("_")):
        function = getattr(library, name, None)
        if not callable(function) or isinstance(function, type):
            continue
        try:
            accepted = inspect.signature(function).parameters
        except (TypeError, ValueError):
            continue
        prices = [c for c in ("open", "high", "low", "close", "volume") if c in accepted or f"{c}_" in accepted]
        if prices:
            register(name, _from_library(module, name, prices), source)
            found.append(name)
    return found


def _from_library(module: str, name: str, prices: list[str]) -> Indicator:
    def apply(df: DataFrame, outputs: tuple[str, ...] | None = None, **parameters) -> DataFrame:
        columns = outputs or (name,)

        def run(bars):
            import pandas as pd

            function = getattr(importlib.import_module(module), name)
            accepted = inspect.signature(function).parameters
            got = function(**{c if c in accepted else f"{c}_": bars[c] for c in prices}, **parameters)
            got = pd.DataFrame(got) if not isinstance(got, pd.DataFrame) else got
            got.columns = [*columns]
            return pd.concat([bars.reset_index(drop=True), got.reset_index(drop=True).astype(float)], axis=1)

        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), *(f"`{c}` double" for c in columns)])
        return grouped(run, schema)(df)

    return apply


def grouped(function, schema: str, key: str = "symbol") -> Indicator:
    """Makes an indicator of a function of one series' pandas frame (the last resort: the series is held in memory)."""
    return lambda df, **parameters: df.groupBy(key).applyInPandas(lambda pdf: function(pdf.sort_values("bar_idx"), **parameters), schema)

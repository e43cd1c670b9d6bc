"""Checks of an analysis on other data than it was made on: splits, walk-forward folds, grids, simulations.

Folds, grid points and simulations are rows: bars are replicated by a join on ranges with a fold's number in the
series key, and one grouped plan runs them all."""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def out_of_sample(bars: DataFrame, share: float = 0.7) -> DataFrame:
    """Bars with part: 'train' for the first share of each series, else 'test'; the part is put into the symbol, so that
    any operator treats the two as series of their own."""
    n = bars.groupBy("symbol").agg((F.floor(F.count(F.lit(1)) * share)).alias("__n"))
    b = bars.join(n, "symbol").withColumn("part", F.when(F.col("bar_idx") < F.col("__n"), "train").otherwise("test"))
    b = b.withColumn("bar_idx", F.when(F.col("part") == "test", F.col("bar_idx") - F.col("__n")).otherwise(F.col("bar_idx")))
    return b.withColumn("series", F.col("symbol")).withColumn("symbol", F.concat_ws("/", "symbol", "part")).drop("__n")


def folds(bars: DataFrame, train: int = 1000, test: int = 200, step: int = 100) -> DataFrame:
    """Bars replicated to each walk-forward fold with fold_id, part and bar_idx from 0 in their part. Fold k trains on
    [k * step, + train) and tests on the test bars after it; a bar's folds follow from its position, so there is no join."""
    whole = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    b = bars.withColumn("__n", whole)
    last = F.floor((F.col("__n") - (train + test)) / step)
    first = F.greatest(F.lit(0), F.ceil((F.col("bar_idx") - (train + test - 1)) / step))
    until = F.least(last, F.floor(F.col("bar_idx") / step))
    b = b.where(last >= 0).withColumn("fold_id", F.explode(F.when(first <= until, F.sequence(first, until)).otherwise(F.array().cast("array<bigint>"))))
    at = F.col("bar_idx") - F.col("fold_id") * step
    b = b.withColumn("part", F.when(at < train, "train").otherwise("test")).withColumn("bar_idx", F.when(at < train, at).otherwise(at - train))
    return b.withColumn("series", F.col("symbol")).withColumn("symbol", F.concat_ws("/", "symbol", F.col("fold_id").cast("string"), "part")).drop("__n")


def degradation(metrics: DataFrame, metric: str, most: float = 20.0, key: tuple[str, ...] = ("series",)) -> DataFrame:
    """(key, train, test, degradation percent, success) from rows with part and metric."""
    own = lambda p: F.max(F.when(F.col("part") == p, F.col(metric)))
    m = metrics.groupBy(*key).agg(own("train").alias("train"), own("test").alias("test"))
    d = F.try_divide(F.col("train") - F.col("test"), F.abs("train")) * 100
    return m.withColumn("degradation", d).withColumn("success", F.coalesce(d <= most, F.lit(False)))


def sensitivity(run: Callable[..., DataFrame], grid: dict[str, list], metric: str) -> DataFrame:
    """One row a grid point and series: run(**point) gives (symbol, metric); points are plans united, not loops over
    collected results."""
    names, out = [*grid], None
    for point in product(*grid.values()):
        one = run(**dict(zip(names, point))).select("symbol", F.col(metric).cast("double").alias(metric), *[F.lit(v).alias(n) for n, v in zip(names, point)])
        out = one if out is None else out.unionByName(one)
    return out


def stability(points: DataFrame, metric: str) -> DataFrame:
    """1 - population deviation over mean of the metric of each series; above 0.8 is stable."""
    s = points.groupBy("symbol").agg(F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std"), F.min(metric).alias("min"), F.max(metric).alias("max"))
    return s.withColumn("stability", 1 - F.try_divide(F.col("std"), F.col("mean"))).withColumn("stable", F.coalesce(F.col("stability") > 0.8, F.lit(False)))


#: Multipliers of a small integer generator that any SQL engine can repeat, modulo 2^31 - 1.
ROUNDS, PRIME = (48271, 69621, 39373), (1 << 31) - 1
FACTORS = (15485863, 32452843, 1000003)


def mixed(seed: int, sim: str = "sim", place: str = "bar_idx") -> Column:
    """A number below 2^31 that follows from seed, simulation and place."""
    x = (F.lit(seed * FACTORS[2]) + F.col(sim).cast("long") * FACTORS[0] + F.col(place).cast("long") * FACTORS[1]) % PRIME
    for m in ROUNDS:
        x = x * m % PRIME
        x = x.bitwiseXOR(F.shiftright(x, 15))
    return x


def simulate(bars: DataFrame, n: int = 1000, seed: int = 42, how: str = "shuffle_returns", whole: bool = False) -> DataFrame:
    """n simulated series for each: returns in random order, prices in random order, or normal returns of the same
    mean and deviation. (symbol = series/sim, series, sim, bar_idx, close), and with whole open, high and low, which keep their
    ratios to the close of the bar in their place (in shuffled prices: of their own bar), and volume and ts of the place. The
    random order follows from (seed, sim, bar), so a repeated task gives the same series."""
    w = Window.partitionBy("symbol").orderBy("bar_idx")
    b = bars.select("symbol", "bar_idx", "close").withColumns({"r": F.ln(F.try_divide(F.col("close"), F.lag("close").over(w))), "first": F.first("close").over(w)})
    s = b.withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    name = F.concat_ws("/", "symbol", F.col("sim").cast("string"))
    mix = Window.partitionBy("symbol", "sim").orderBy("h", "bar_idx")
    line = Window.partitionBy("symbol", "sim").orderBy("bar_idx").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumns({"own": F.col("bar_idx"), "h": mixed(seed)})
    if how == "shuffle_prices":
        s = s.withColumn("bar_idx", (F.row_number().over(mix) - 1).cast("long"))
    elif how == "shuffle_returns":
        # the first bar stays; it has no return
        s = s.withColumn("h", F.when(F.col("bar_idx") > 0, F.col("h")).otherwise(-1)).withColumn("bar_idx", (F.row_number().over(mix) - 1).cast("long"))
        s = s.withColumn("close", F.col("first") * F.exp(F.sum(F.coalesce("r", F.lit(0.0))).over(line)))
    elif how == "gaussian":
        unit = lambda k: (mixed(seed + k) + 0.5) / float(1 << 31)
        g = F.sqrt(-2 * F.ln(unit(1))) * F.cos(2 * F.pi() * unit(2))
        figures = b.groupBy("symbol").agg(F.avg("r").alias("m"), F.stddev_samp("r").alias("d"))
        s = s.join(figures, "symbol").withColumn("close", F.col("first") * F.exp(F.sum(F.when(F.col("bar_idx") > 0, F.col("m") + F.col("d") * g).otherwise(0.0)).over(line)))
    else:
        raise ValueError(f"unknown simulation {how}")
    out = s.select(name.alias("symbol"), F.col("symbol").alias("series"), "sim", "bar_idx", "close", "own")
    if whole:
        ratio = lambda c: F.try_divide(F.col(c), F.col("close")).alias(f"__{c}")
        place = "own" if how == "shuffle_prices" else "bar_idx"
        out = out.join(bars.select(F.col("symbol").alias("series"), F.col("bar_idx").alias(place), *map(ratio, ("open", "high", "low"))), ["series", place])
        out = out.join(bars.select(F.col("symbol").alias("series"), "bar_idx", "ts", "volume"), ["series", "bar_idx"])
        out = out.withColumns({c: F.col("close") * F.col(f"__{c}") for c in ("open", "high", "low")})
    return out.select("symbol", "series", "sim", "bar_idx", *(("ts", "open", "high", "low") if whole else ()), "close", *(("volume",) if whole else ()))


def against_simulations(real: DataFrame, simulated: DataFrame, metric: str) -> DataFrame:
    """(symbol, real, rank): the share of a series' simulations below the real value; success above 0.95."""
    s = simulated.join(real.select(F.col("symbol").alias("series"), F.col(metric).alias("real")), "series")
    a = s.groupBy(F.col("series").alias("symbol")).agg(F.first("real").alias("real"), (F.count_if(F.col(metric) < F.col("real")) / F.count(F.lit(1))).alias("rank"), F.count(F.lit(1)).alias("simulations"))
    return a.withColumn("success", F.col("rank") > 0.95)

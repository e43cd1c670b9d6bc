"""Statistics of the order of zones: transitions, runs, patterns, Markov chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators.describe import with_p_values


def _order() -> Window:
    return Window.partitionBy("symbol").orderBy("start_idx")


def transitions(zones: DataFrame) -> DataFrame:
    """(symbol, transition, n, probability): pairs of consecutive types as a share of all pairs of the series."""
    t = zones.withColumn("next", F.lead("type").over(_order())).where("next is not null")
    g = t.groupBy("symbol", F.concat_ws("_to_", "type", "next").alias("transition")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("probability", F.col("n") / F.sum("n").over(Window.partitionBy("symbol")))


def transition_details(features: DataFrame) -> DataFrame:
    """Mean duration and return of the zones before and after each kind of transition."""
    t = features.withColumns({"next": F.lead("type").over(_order()), "d2": F.lead("duration").over(_order()), "r2": F.lead("price_return").over(_order())}).where("next is not null")
    return t.groupBy("symbol", F.concat_ws("_to_", "type", "next").alias("transition")).agg(F.count(F.lit(1)).alias("n"), F.avg("duration").alias("duration_before"), F.avg("d2").alias("duration_after"), F.avg("price_return").alias("return_before"), F.avg("r2").alias("return_after"))


def triplets(zones: DataFrame) -> DataFrame:
    t = zones.withColumns({"b": F.lead("type", 1).over(_order()), "c": F.lead("type", 2).over(_order())}).where("c is not null")
    return t.groupBy("symbol", F.concat_ws("-", "type", "b", "c").alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


def runs(zones: DataFrame) -> DataFrame:
    """(symbol, type, run, length): runs of zones of one type."""
    z = zones.withColumn("new", F.coalesce((F.lag("type").over(_order()) != F.col("type")).cast("int"), F.lit(1)))
    z = z.withColumn("run", F.sum("new").over(_order().rowsBetween(Window.unboundedPreceding, 0)))
    return z.groupBy("symbol", "type", "run").agg(F.count(F.lit(1)).alias("length"))


def run_lengths(zones: DataFrame) -> DataFrame:
    return runs(zones).groupBy("symbol", "type").agg(F.count(F.lit(1)).alias("runs"), F.avg("length").alias("mean"), F.max("length").alias("max"), F.min("length").alias("min"), F.stddev_pop("length").alias("std"))


def markov(zones: DataFrame) -> DataFrame:
    """One row a series: counts between bull and bear, row probabilities, and the stationary share of each, in closed
    form; without any change it is where the chain stays."""
    two = zones.where(F.col("type").isin("bull", "bear")).withColumn("next", F.lead("type").over(_order())).where("next is not null")
    cell = lambda a, b: F.count_if((F.col("type") == a) & (F.col("next") == b)).alias(f"{a}_{b}")
    m = two.groupBy("symbol").agg(cell("bull", "bull"), cell("bull", "bear"), cell("bear", "bull"), cell("bear", "bear"))
    share = lambda a, b, other: F.coalesce(F.try_divide(F.col(f"{a}_{b}"), F.col(f"{a}_{b}") + F.col(f"{a}_{other}")), F.lit(0.0))
    m = m.withColumns({"p_bull_bear": share("bull", "bear", "bull"), "p_bear_bull": share("bear", "bull", "bear")})
    total = F.col("p_bull_bear") + F.col("p_bear_bull")
    return m.withColumns({"stationary_bull": F.try_divide(F.col("p_bear_bull"), total), "stationary_bear": F.try_divide(F.col("p_bull_bear"), total)})


def runs_test(zones: DataFrame) -> DataFrame:
    """Wald-Wolfowitz: runs of bull against everything else, expected number, variance, z, p_value, whether the order looks random."""
    z = zones.withColumn("up", F.col("type") == "bull")
    z = z.withColumn("new", F.coalesce((F.lag("up").over(_order()) != F.col("up")).cast("int"), F.lit(1)))
    a = z.groupBy("symbol").agg(F.sum("new").alias("runs"), F.count_if("up").cast("double").alias("n1"), F.count_if(~F.col("up")).cast("double").alias("n2"))
    n, n1, n2 = F.col("n1") + F.col("n2"), F.col("n1"), F.col("n2")
    a = a.withColumns({"expected": 2 * n1 * n2 / n + 1, "variance": F.try_divide(2 * n1 * n2 * (2 * n1 * n2 - n), n * n * (n - 1))})
    a = a.withColumn("z", F.when(F.col("variance") > 0, (F.col("runs") - F.col("expected")) / F.sqrt("variance")))
    return with_p_values(a, "normal", "z").withColumn("is_random", F.col("p_value") > 0.05)


def uniformity(zones: DataFrame) -> DataFrame:
    """Chi-squared of the numbers of bull and bear zones against half of all zones each."""
    a = zones.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("type") == "bull").alias("bull"), F.count_if(F.col("type") == "bear").alias("bear"))
    half = F.col("n") / 2
    a = a.withColumn("chi2", (F.pow(F.col("bull") - half, F.lit(2)) + F.pow(F.col("bear") - half, F.lit(2))) / half).withColumn("df", F.lit(1))
    return with_p_values(a, "chi2", "chi2", "df").drop("df").withColumn("is_uniform", F.col("p_value") > 0.05)

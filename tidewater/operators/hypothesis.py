"""Hypothesis tests over zone features.

Spark reduces the features to a few sums; statistics and p-values follow from these on the driver. Each test is a dict:
name, statistic, p_value, significant, effect_size, n, and what it needs to be read."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.distributions import chi2_sf, holm, kolmogorov_sf, normal_sf, t_two_sided
from tidewater.functions.series import correlation
from tidewater.storage import written

ALPHA = 0.05


def _result(name: str, statistic: float | None, p: float | None, n: int, effect: float | None = None, alpha: float = ALPHA, **more) -> dict:
    return {"name": name, "statistic": statistic, "p_value": p, "significant": p is not None and p < alpha, "effect_size": effect, "n": n} | more


def two_sample_t(name: str, a: tuple, b: tuple, **more) -> dict:
    """Pooled t-test of two samples given as (n, mean, variance)."""
    (n1, m1, v1), (n2, m2, v2) = a, b
    if min(n1, n2) < 2 or None in (v1, v2):
        return _result(name, None, None, n1 + n2, error="too few rows", **more)
    pooled = ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)
    if pooled <= 0:
        return _result(name, None, None, n1 + n2, error="no variance", **more)
    t = (m1 - m2) / math.sqrt(pooled * (1 / n1 + 1 / n2))
    return _result(name, t, t_two_sided(t, n1 + n2 - 2), n1 + n2, (m1 - m2) / math.sqrt(pooled), mean_1=m1, mean_2=m2, **more)


def one_sample_t(df: DataFrame, column: str, mean: float = 0.0, alternative: str = "two-sided") -> dict:
    r = df.agg(F.count(column), F.avg(column), F.stddev_samp(column)).first()
    if r[0] < 2 or not r[2]:
        return _result("one_sample_t", None, None, r[0], error="too few rows")
    t = (r[1] - mean) / (r[2] / math.sqrt(r[0]))
    p = t_two_sided(t, r[0] - 1)
    if alternative != "two-sided":
        p = p / 2 if (t > 0) == (alternative == "greater") else 1 - p / 2
    return _result("one_sample_t", t, p, r[0], (r[1] - mean) / r[2])


def _sums(df: DataFrame, column: str, group) -> dict:
    rows = df.withColumn("__g", group).where("__g is not null").groupBy("__g").agg(F.count(column).alias("n"), F.avg(column).alias("m"), F.var_samp(column).alias("v")).collect()
    return {r["__g"]: (r["n"], r["m"], r["v"]) for r in rows}


NONE = (0, None, None)


def duration_effect(f: DataFrame) -> dict:
    """Do the longest and shortest fifths of zones differ in return?"""
    q = f.agg(F.percentile("duration", F.array(F.lit(0.2), F.lit(0.8)))).first()[0]
    if not q or q[0] is None:
        return _result("zone_duration", None, None, 0, error="no rows")
    g = _sums(f, "price_return", F.when(F.col("duration") >= q[1], "long").when(F.col("duration") <= q[0], "short"))
    return two_sample_t("zone_duration", g.get("long", NONE), g.get("short", NONE))


def _pearson(name: str, r: float | None, n: int, **more) -> dict:
    if r is None or n < 3:
        return _result(name, None, None, n, error="too few rows", **more)
    if not math.isfinite(r):
        return _result(name, r, None, n, r, error="not finite", **more)
    t = math.inf if abs(r) >= 1 else r * math.sqrt((n - 2) / (1 - r * r))
    p = 0.0 if math.isinf(t) else t_two_sided(t, n - 2)
    ci = None
    if n > 3 and abs(r) < 1:
        z, s = math.atanh(r), 1.959963984540054 / math.sqrt(n - 3)
        ci = (math.tanh(z - s), math.tanh(z + s))
    return _result(name, r, p, n, r, interval=ci, **more)


def _corr(f: DataFrame, pairs: list[tuple[str, str]]) -> list[tuple[float | None, int]]:
    aggs = []
    for a, b in pairs:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        aggs += [correlation(a, b), F.count_if(both)]
    r = f.agg(*aggs).first()
    return [(r[2 * k], r[2 * k + 1]) for k in range(len(pairs))]


def slope_duration(f: DataFrame) -> dict:
    (r, n), = _corr(f, [("hist_slope", "duration")])
    return _pearson("histogram_slope", r, n)


def asymmetry(f: DataFrame) -> dict:
    """Do bull and bear zones differ in duration or return (Bonferroni)?"""
    out = []
    for c in ("duration", "price_return"):
        g = _sums(f, c, F.when(F.col("type").isin("bull", "bear"), F.col("type")))
        out.append(two_sample_t(c, g.get("bull", NONE), g.get("bear", NONE)))
    ps = [x["p_value"] for x in out if x["p_value"] is not None]
    p = min(1.0, 2 * min(ps)) if ps else None
    return _result("bull_bear_asymmetry", out[0]["statistic"], p, out[0]["n"], out[0]["effect_size"], parts=out)


def sequence_patterns(f: DataFrame) -> dict:
    """Are transitions uniform over the observed kinds, and are runs as many as chance gives (Bonferroni)?"""
    from tidewater.operators.sequences import runs_test, transitions

    t = transitions(f).groupBy("transition").agg(F.sum("n").alias("n")).collect()
    n = sum(r["n"] for r in t)
    if len(t) < 2:
        return _result("sequence_patterns", None, None, n, error="too few kinds")
    e = n / len(t)
    chi2 = sum((r["n"] - e) ** 2 / e for r in t)
    p1 = chi2_sf(chi2, len(t) - 1)
    z = runs_test(f).agg(F.sum(F.col("runs") - F.col("expected")).alias("d"), F.sum("variance").alias("v")).first()
    p2 = 2 * normal_sf(abs(z["d"]) / math.sqrt(z["v"])) if z["v"] else 1.0
    return _result("sequence_patterns", chi2, min(1.0, 2 * min(p1, p2)), n, math.sqrt(chi2 / n), p_uniform=p1, p_runs=p2)


def volatility_effects(f: DataFrame) -> dict:
    """Does a measure of volatility go with duration, amplitude or return (Holm)?"""
    proxy = next((c for c in ("price_return_atr", "atr") if c in f.columns), None)
    f = f.withColumn("__v", F.col(proxy) if proxy else F.abs("price_return"))
    names = [c for c in ("duration", "macd_amplitude", "price_return") if c in f.columns]
    parts = [_pearson(c, r, n) for c, (r, n) in zip(names, _corr(f, [("__v", c) for c in names]))]
    if odd := next((x for x in parts if x.get("error") == "not finite"), None):
        return odd | {"name": "volatility_effects", "strongest": odd["name"], "parts": parts}
    good = [x for x in parts if x["p_value"] is not None]
    if not good:
        return _result("volatility_effects", None, None, 0, error="too few rows")
    ps = holm([x["p_value"] for x in good])
    k = min(range(len(good)), key=lambda i: ps[i])
    return _result("volatility_effects", good[k]["statistic"], ps[k], good[k]["n"], good[k]["effect_size"], strongest=good[k]["name"], parts=good)


def correlation_drawdown(f: DataFrame) -> dict:
    """Do zones whose indicator follows the price differ in drawdown from those where it does not?"""
    d = f.select("correlation_price_hist", F.abs("drawdown_from_peak").alias("d")).where("d is not null")
    d = d.unionByName(f.select("correlation_price_hist", F.abs("rally_from_trough").alias("d")).where("d is not null")).where("correlation_price_hist is not null")
    n = d.count()
    if n < 10:
        return _result("correlation_drawdown", None, None, n, error="too few rows")
    r = F.col("correlation_price_hist")
    g = _sums(d, "d", F.when(r > 0.7, "high").when(r < 0.3, "low"))
    if min(g.get("high", NONE)[0], g.get("low", NONE)[0]) < 2:
        q = d.agg(F.percentile("correlation_price_hist", F.array(F.lit(0.2), F.lit(0.8)))).first()[0]
        g = _sums(d, "d", F.when(r >= q[1], "high").when(r <= q[0], "low"))
    return two_sample_t("correlation_drawdown", g.get("high", NONE), g.get("low", NONE))


#: MacKinnon's response surface for the Dickey-Fuller statistic with a constant.
_ADF_MIN, _ADF_MAX, _ADF_STAR = -18.83, 2.74, -1.61
_ADF_SMALL, _ADF_LARGE = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)


def adf_p(t: float) -> float:
    if t > _ADF_MAX:
        return 1.0
    if t < _ADF_MIN:
        return 0.0
    return 1 - normal_sf(sum(c * t**k for k, c in enumerate(_ADF_SMALL if t <= _ADF_STAR else _ADF_LARGE)))


class _Adf:
    """Augmented Dickey-Fuller with a constant; lags by the Akaike criterion on the common sample. The values of a
    series of known length come in order, in pieces; only sums of products of a row's terms and the first rows stay."""

    def __init__(self, n: int, shift: float = 0.0):
        self.n, self.shift, self.most = n, shift, max(0, min(int(math.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2))
        self.tail, self.head, self.seen = np.zeros(0), np.zeros(0), 0
        self.sums = np.zeros((self.most + 3, self.most + 3))
        self.low, self.high, self.trend = math.inf, -math.inf, np.zeros(3)

    def _terms(self, x: np.ndarray, lags: int) -> np.ndarray:
        """Difference, value before, constant, lagged differences: a row for each value that has all of them."""
        dx = np.diff(x)
        return np.column_stack([dx[lags:], x[lags:-1], np.ones(len(dx) - lags), *[dx[lags - k : len(dx) - k] for k in range(1, lags + 1)]])

    def add(self, x: np.ndarray) -> None:
        if not len(x):
            return
        x = x - self.shift
        i = np.arange(self.seen, self.seen + len(x)) - (self.n - 1) / 2
        self.trend += [i @ x, x.sum(), x @ x]
        self.low, self.high, self.seen = min(self.low, x.min()), max(self.high, x.max()), self.seen + len(x)
        if len(self.head) <= self.most:
            self.head = np.concatenate([self.head, x[: self.most + 1 - len(self.head)]])
        x = np.concatenate([self.tail, x])
        if len(x) > self.most + 1:
            z = self._terms(x, self.most)
            self.sums += z.T @ z
        self.tail = x[-(self.most + 1) :]

    def _fit(self, sums: np.ndarray, lags: int) -> tuple[float, float, float]:
        """Rows, sum of squared errors, the value's t."""
        g, c, rows = sums[1 : lags + 3, 1 : lags + 3], sums[0, 1 : lags + 3], float(sums[2, 2])
        size = np.sqrt(np.maximum(np.diag(g), 1e-300))
        inverse = np.linalg.pinv(g / np.outer(size, size), hermitian=True) / np.outer(size, size)
        b = inverse @ c
        rss = max(0.0, float(sums[0, 0] - b @ c))
        s = math.sqrt(rss / max(1.0, rows - lags - 2) * max(inverse[0, 0], 0.0))
        return rows, rss, float(b[0] / s) if s else -math.inf if b[0] < 0 else math.inf

    def result(self) -> tuple[float, float, int]:
        """t, p, lags."""

        def aic(lags: int) -> float:
            rows, rss, _ = self._fit(self.sums, lags)
            return rows * (math.log(2 * math.pi * max(rss, 1e-300) / rows) + 1) + 2 * (lags + 2)

        best = min(range(self.most + 1), key=aic)
        sums = self.sums[: best + 3, : best + 3].copy()
        if best < self.most:
            z = self._terms(self.head, best)
            sums += z.T @ z
        t = self._fit(sums, best)[2]
        return t, adf_p(t), best

    def slope(self) -> float:
        """Correlation of the values and their places."""
        own = self.trend[2] - self.trend[1] ** 2 / self.n
        return float(self.trend[0] / math.sqrt(own * self.n * (self.n**2 - 1) / 12))


def adf(x: np.ndarray) -> tuple[float, float, int]:
    """Augmented Dickey-Fuller of one array: t, p, lags."""
    one = _Adf(len(x), float(np.mean(x)))
    one.add(np.asarray(x, dtype=float))
    return one.result()


def _stationarity(symbol: str, one: _Adf, alpha: float = ALPHA) -> tuple:
    error = "too few rows" if one.n < 10 else "constant" if one.low == one.high else None
    if error:
        return symbol, None, None, False, one.n, None, None, error
    t, p, lags = one.result()
    return symbol, t, p, p < alpha, one.n, lags, one.slope(), None


def duration_stationarity_of_series(f: DataFrame) -> DataFrame:
    """Unit root of the durations in order, one row a symbol: statistic, p_value, significant, n, lags, trend, error. A
    series is read once, in pieces, so it may have any number of zones."""
    whole = Window.partitionBy("symbol")
    d = f.select("symbol", "start_idx", F.col("duration").cast("double").alias("d")).where("d is not null")
    d = d.withColumns({"n": F.count(F.lit(1)).over(whole), "m": F.avg("d").over(whole)}).repartition("symbol").sortWithinPartitions("symbol", "start_idx")
    schema = pa.schema([("symbol", pa.string()), ("statistic", pa.float64()), ("p_value", pa.float64()), ("significant", pa.bool_()), ("n", pa.int64()), ("lags", pa.int32()), ("trend", pa.float64()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, one = None, None
        row = lambda: pa.RecordBatch.from_pylist([dict(zip(schema.names, _stationarity(now, one)))], schema)
        for b in batches:
            symbols, x = b.column("symbol").to_pylist(), b.column("d").to_numpy(zero_copy_only=False)
            starts = [k for k in range(len(symbols)) if k == 0 or symbols[k] != symbols[k - 1]]
            for i, j in zip(starts, [*starts[1:], len(symbols)]):
                if one is None or symbols[i] != now:
                    if one is not None:
                        yield row()
                    now, one = symbols[i], _Adf(b.column("n")[i].as_py(), b.column("m")[i].as_py())
                one.add(x[i:j])
        if one is not None:
            yield row()

    return d.mapInArrow(run, "symbol string, statistic double, p_value double, significant boolean, n long, lags int, trend double, error string")


def duration_stationarity(f: DataFrame) -> dict:
    """Unit root of the durations in order; series has the result of each, and where there is one only, it is the whole."""
    name = "duration_stationarity"
    series = [r.asDict() | {"name": name, "effect_size": None} for r in duration_stationarity_of_series(f).orderBy("symbol").collect()]
    if len(series) == 1:
        return series[0] | {"series": series}
    return _result(name, None, None, sum(r["n"] for r in series), series=series, error=f"{len(series)} series, each tested by itself" if series else "too few rows")


def by_value(df: DataFrame, column: str, counts: dict) -> DataFrame:
    """One row a distinct value x with counts n_{name} and before_{name}, how many rows have smaller values. Values are
    sorted by ranges, so that no task holds them all; the ranges' totals, one row each, are carried on."""
    d = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("x")).agg(*[c.alias(f"n_{n}") for n, c in counts.items()])
    d = written(d.repartitionByRange("x").withColumn("part", F.spark_partition_id()), "values")
    upto = lambda w, n: F.coalesce(F.sum(f"n_{n}").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = d.groupBy("part").agg(*[F.sum(f"n_{n}").alias(f"n_{n}") for n in counts])
    parts = parts.select("part", *[upto(Window.orderBy("part"), n).alias(f"part_{n}") for n in counts])
    d = d.join(F.broadcast(parts), "part")
    inner = Window.partitionBy("part").orderBy("x")
    return d.select("x", *[f"n_{n}" for n in counts], *[(upto(inner, n) + F.col(f"part_{n}")).alias(f"before_{n}") for n in counts])


def mann_whitney(df: DataFrame, column: str, group: str, first, second) -> dict:
    """Normal approximation with ties and continuity; effect: rank-biserial."""
    d = df.where(F.col(group).isin(first, second))
    v = by_value(d, column, {"a": F.count_if(F.col(group) == F.lit(first)), "all": F.count(F.lit(1))})
    rank = F.col("before_all") + (F.col("n_all") + 1) / 2
    r = v.agg(F.sum("n_a"), F.sum("n_all"), F.sum(F.col("n_a") * rank), F.sum(F.pow("n_all", F.lit(3)) - F.col("n_all"))).first()
    n1, n = r[0] or 0, r[1] or 0
    n2 = n - n1
    if not n1 or not n2:
        return _result("mann_whitney", None, None, n, error="a group is empty")
    u = r[2] - n1 * (n1 + 1) / 2
    s = math.sqrt(n1 * n2 / 12 * (n + 1 - r[3] / (n * (n - 1))))
    z = (abs(u - n1 * n2 / 2) - 0.5) / s if s else 0.0
    return _result("mann_whitney", u, min(1.0, 2 * normal_sf(max(z, 0.0))), n, 2 * u / (n1 * n2) - 1)


#: Royston's approximation of the weights and of the distribution of Shapiro and Wilk's W.
_LAST, _NEXT = (0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056), (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
_SMALL_MEAN, _SMALL_LOG = (0.5440, -0.39978, 0.025054, -0.0006714), (1.3822, -0.77857, 0.062767, -0.0020322)
_LARGE_MEAN, _LARGE_LOG = (-1.5861, -0.31082, -0.083751, 0.0038915), (-0.4803, -0.082676, 0.0030302)
#: Values up to which the approximation of Shapiro and Wilk's test holds.
SHAPIRO_MOST = 5000


def shapiro(x: np.ndarray) -> tuple[float, float]:
    """W and p of 3 to SHAPIRO_MOST values that aren't all equal."""
    n, x = len(x), np.sort(np.asarray(x, dtype=float))
    poly = lambda c, t: sum(v * t**k for k, v in enumerate(c))
    m = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    square, u = float(m @ m), 1 / math.sqrt(n)
    a = m / math.sqrt(square)
    if n == 3:
        a = np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    else:
        last, inner = a[-1] + poly(_LAST, u), a[-2] + poly(_NEXT, u)
        k = 2 if n > 5 else 1
        ends = 2 * last**2 + (2 * inner**2 if k == 2 else 0)
        a = m / math.sqrt((square - 2 * float(m[n - k :] @ m[n - k :])) / (1 - ends))
        a[-1], a[0] = last, -last
        if k == 2:
            a[-2], a[1] = inner, -inner
    w = min(1.0, float(a @ x) ** 2 / float(((x - x.mean()) ** 2).sum()))
    if n == 3:
        return w, max(0.0, min(1.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))))
    left = math.log(max(1 - w, 1e-300))
    if n <= 11:
        y, mean, spread = -math.log(max(0.459 * n - 2.273 - left, 1e-300)), poly(_SMALL_MEAN, n), math.exp(poly(_SMALL_LOG, n))
    else:
        y, mean, spread = left, poly(_LARGE_MEAN, math.log(n)), math.exp(poly(_LARGE_LOG, math.log(n)))
    return w, normal_sf((y - mean) / spread)


def normality(df: DataFrame, column: str) -> dict:
    """Kolmogorov-Smirnov and Anderson-Darling against the fitted normal, and Shapiro-Wilk where it is defined, for up to
    SHAPIRO_MOST values."""
    n, m, s = df.agg(F.count(column), F.avg(column), F.stddev_samp(column)).first()
    if n < 3 or not s:
        return {"n": n, "error": "too few rows"}
    v = by_value(df, column, {"all": F.count(F.lit(1))})
    before, own = F.col("before_all"), F.col("n_all")
    after = n - before - own
    v = v.withColumn("p", F.greatest(F.lit(1e-300), F.least(F.lit(1 - 1e-16), _phi((F.col("x") - m) / s))))
    # equal values take several places at once
    square = lambda a: F.pow(a + own, F.lit(2)) - F.pow(a, F.lit(2))
    ks, ad = v.agg(F.max(F.greatest((before + own) / n - F.col("p"), F.col("p") - before / n)), F.sum(square(before) * F.ln("p") + square(after) * F.ln(1 - F.col("p")))).first()
    a2 = -n - ad / n
    out = {"n": n, "ks": ks, "ks_p": kolmogorov_sf(ks, n), "anderson": a2, "anderson_critical_5": 0.787 / (1 + 4 / n - 25 / n**2)}
    out |= {"normal": out["ks_p"] > ALPHA}
    if n <= SHAPIRO_MOST:
        w, p = shapiro(np.array([r[0] for r in df.where(F.col(column).isNotNull()).select(F.col(column).cast("double")).collect()]))
        out |= {"shapiro": w, "shapiro_p": p}
    return out


def _looks_normal(df: DataFrame, column: str) -> bool:
    """By Shapiro-Wilk where it is defined, else by Anderson-Darling; fewer than three values always do."""
    r = normality(df, column)
    return "error" in r or (r["shapiro_p"] >= ALPHA if "shapiro_p" in r else r["anderson"] < r["anderson_critical_5"])


def support_resistance_effect(f: DataFrame, levels: DataFrame | None = None, tolerance: float = 0.005) -> dict:
    """Do zones that start near a level of their series last longer or shorter? Levels (symbol, level) are those that two or
    more ends of zones touch, unless given. By a t-test if both groups look normal, else by Mann-Whitney."""
    from tidewater.operators.levels import near_levels, price_levels

    name = "support_resistance"
    if levels is None:
        ends = f.select("symbol", F.col("start_price").alias("p")).unionByName(f.select("symbol", F.col("end_price").alias("p")))
        levels = written(price_levels(ends, "p").where("n >= 2"), "levels")
    d = f.select("symbol", "start_price", "duration").where("duration is not null")
    near, far = (near_levels(d, levels, "start_price", tolerance, n) for n in (True, False))
    d = written(near.withColumn("near", F.lit(True)).unionByName(far.withColumn("near", F.lit(False))), "near-levels")
    g = _sums(d, "duration", F.col("near"))
    if True not in g or False not in g:
        return _result(name, None, None, sum(x[0] for x in g.values()), error="all zones are near a level, or none")
    more = {"near": g[True][0], "far": g[False][0], "mean_near": g[True][1], "mean_far": g[False][1]}
    if _looks_normal(d.where("near"), "duration") and _looks_normal(d.where("not near"), "duration"):
        return two_sample_t(name, g[True], g[False]) | more | {"test": "t"}
    r = mann_whitney(d, "duration", "near", True, False)
    return r | {"name": name, "effect_size": -r["effect_size"] if r["effect_size"] is not None else None} | more | {"test": "mann_whitney"}


def _phi(z):
    """Normal distribution function as a column (Abramowitz and Stegun 7.1.26, error below 1.5e-7)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    e = 1 - t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)
    return F.when(z >= 0, (1 + e) / 2).otherwise((1 - e) / 2)


def analyze(df: DataFrame, columns: list[str]) -> dict:
    """Descriptions, normality of each column and the three correlations of each pair: tables and rows as results."""
    from tidewater.operators.describe import correlation_tests, describe

    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"no such columns: {missing}")
    all_ = df.withColumn("all", F.lit("all"))
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    return {"descriptive": describe(df, columns), "normality": {c: normality(df, c) for c in columns}, "correlations": {f"{a}_vs_{b}": correlation_tests(all_, a, b, ["all"]) for a, b in pairs}}


TESTS: dict[str, Callable[[DataFrame], dict]] = {
    "zone_duration": duration_effect, "histogram_slope": slope_duration, "bull_bear_asymmetry": asymmetry, "sequence_patterns": sequence_patterns,
    "volatility_effects": volatility_effects, "correlation_drawdown": correlation_drawdown, "duration_stationarity": duration_stationarity,
    "support_resistance": support_resistance_effect,
}


def run_all(features: DataFrame, names: Iterable[str] = tuple(TESTS)) -> dict[str, dict]:
    """All tests, or those named; what one cannot do with these rows is in its error."""
    out = {}
    for name in names:
        try:
            out[name] = TESTS[name](features)
        except (ValueError, ZeroDivisionError, ArithmeticError) as e:
            out[name] = _result(name, None, None, 0, error=str(e))
    return out

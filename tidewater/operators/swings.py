"""Swing points and what moves between them.

Swings are a table (symbol, point_id, bar_idx, price, swing_type, amplitude_to_next, duration_to_next,
confirmation_index). Fractal pivots are plain windows. Peaks with prominence and zigzag legs depend on all earlier
bars of a series, so these two run as grouped maps with numpy, one series (or zone) at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.series import quotient

#: Parameter sets of the strategies.
PRESETS = {
    "default": {"zigzag": {"legs": 10, "deviation": 0.05}, "find_peaks": {"prominence": 0.015, "distance": 5, "min_amplitude_pct": 0.02}, "pivot_points": {"left": 2, "right": 2, "min_amplitude_pct": 0.015}},
    "narrow_zone": {"zigzag": {"legs": 3, "deviation": 0.008}, "find_peaks": {"prominence": 0.004, "distance": 3, "min_amplitude_pct": 0.006}, "pivot_points": {"left": 2, "right": 2, "min_amplitude_pct": 0.006}},
}
POINT = "symbol string, bar_idx long, price double, swing_type string, confirmation_index long"


def pivot_points(df: DataFrame, left: int = 2, right: int = 2, key: list[str] | None = None) -> DataFrame:
    """Highs strictly above, and lows strictly below, left bars before and right bars after within the key."""
    key = key or ["symbol"]
    w = Window.partitionBy(*key).orderBy("bar_idx")

    def extreme(c: str, above: bool):
        around = [F.lag(c, k).over(w) for k in range(1, left + 1)] + [F.lead(c, k).over(w) for k in range(1, right + 1)]
        hit = F.lit(True)
        for x in around:
            hit &= (F.col(c) > x) if above else (F.col(c) < x)
        return F.coalesce(hit, F.lit(False))

    last = F.max("bar_idx").over(Window.partitionBy(*key))
    df = df.withColumns({"__p": extreme("high", True), "__t": extreme("low", False), "__last": last})
    confirm = F.when(F.col("bar_idx") + right <= F.col("__last"), F.col("bar_idx") + right)
    point = lambda kind, c: F.struct(F.lit(kind).alias("swing_type"), F.col(c).cast("double").alias("price"))
    some = F.filter(F.array(F.when(F.col("__p"), point("peak", "high")), F.when(F.col("__t"), point("trough", "low"))), lambda x: x.isNotNull())
    return df.where("__p or __t").select(*key, "bar_idx", F.explode(some).alias("s"), confirm.alias("confirmation_index")).select(*key, "bar_idx", "s.price", "s.swing_type", "confirmation_index")


def local_peaks(x: np.ndarray, height: float | None = None, distance: int | None = None, prominence: float | None = None) -> np.ndarray:
    """Positions of local maxima: strict ones and the middles of plateaus; of those at least height high, then by
    falling height none within distance of a kept one, then those that stand out by prominence."""
    n = len(x)
    if n < 3:
        return np.zeros(0, dtype=np.int64)
    # runs of equal values that are left and right of something lower
    heads = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    tails = np.append(heads[1:], n) - 1
    inner = (heads > 0) & (tails < n - 1)
    heads, tails = heads[inner], tails[inner]
    top = (x[heads - 1] < x[heads]) & (x[tails + 1] < x[tails])
    peaks = (heads[top] + tails[top]) // 2
    if height is not None:
        peaks = peaks[x[peaks] >= height]
    if distance is not None and distance > 1 and len(peaks):
        first, end = np.searchsorted(peaks, peaks - distance, side="right"), np.searchsorted(peaks, peaks + distance)
        keep = np.ones(len(peaks), dtype=bool)
        for k in np.argsort(x[peaks], kind="stable")[::-1]:
            if keep[k]:
                keep[first[k] : end[k]] = False
                keep[k] = True
        peaks = peaks[keep]
    if prominence is not None and len(peaks):
        base = np.maximum(_valleys(x), _valleys(x[::-1])[::-1])
        peaks = peaks[x[peaks] - base[peaks] >= prominence]
    return peaks


def _valleys(x: np.ndarray) -> np.ndarray:
    """For each place the least value back to the last one that is higher, itself included; one pass with a stack."""
    out, stack = np.empty(len(x)), []
    for k, v in enumerate(x.tolist()):
        low = v
        while stack and stack[-1][0] <= v:
            low = min(low, stack.pop()[1])
        stack.append((v, low))
        out[k] = low
    return out


def _confirmed(x: np.ndarray, start: int, level: float, below: bool) -> int | None:
    hit = np.flatnonzero(x[start:] <= level if below else x[start:] >= level)
    return int(start + hit[0]) if len(hit) else None


def peak_points(df: DataFrame, prominence: float | str | None = None, distance: int = 5, key: list[str] | None = None) -> DataFrame:
    """Peaks of high and troughs of low; prominence is a price, a column with each key's, or a hundredth of the range if None."""
    key = key or ["symbol"]
    own = [prominence] if isinstance(prominence, str) else []

    def run(bars: pd.DataFrame) -> pd.DataFrame:
        bars = bars.sort_values("bar_idx")
        hi, lo, at = bars["high"].to_numpy(float), bars["low"].to_numpy(float), bars["bar_idx"].to_numpy()
        need = float(bars[own[0]].iloc[0]) if own else prominence if prominence is not None else max(0.01 * (np.nanmax(hi) - np.nanmin(lo)), 1e-9)
        rows = []
        for kind, x, sign in (("peak", hi, 1.0), ("trough", lo, -1.0)):
            for p in local_peaks(sign * x, distance=distance, prominence=need):
                back = _confirmed(lo if sign > 0 else hi, p + 1, x[p] - sign * need, sign > 0)
                ready = None if back is None else max(p + distance, back)
                rows.append((*[bars[k].iloc[0] for k in key], at[p], x[p], kind, at[ready] if ready is not None and ready < len(at) else None))
        return pd.DataFrame(rows, columns=[*key, "bar_idx", "price", "swing_type", "confirmation_index"]).astype({"confirmation_index": "Int64"})

    schema = POINT if key == ["symbol"] else POINT.replace("symbol string,", "symbol string, zone_id long,")
    return df.select(*key, "bar_idx", "high", "low", *own).groupBy(*key).applyInPandas(run, schema)


def zigzag_points(df: DataFrame, deviation: float | str = 0.05, legs: int = 10, key: list[str] | None = None) -> DataFrame:
    """Alternating extremes at least deviation (a fraction) apart. Going up, the highest high so far is the
    candidate; a low that is deviation below makes it a peak and turns the leg, and so mirrored. The open end is no
    point. A series with fewer distinct highs or lows than legs, or fewer than 2 * legs bars, has none. deviation may be
    a column with each key's."""
    key = key or ["symbol"]
    own = [deviation] if isinstance(deviation, str) else []

    def run(bars: pd.DataFrame) -> pd.DataFrame:
        bars = bars.sort_values("bar_idx")
        hi, lo, at = bars["high"].to_numpy(float), bars["low"].to_numpy(float), bars["bar_idx"].to_numpy()
        rows, turn = [], float(bars[own[0]].iloc[0]) if own else deviation
        if len(at) >= 2 * legs and min(len(np.unique(hi)), len(np.unique(lo))) >= legs:
            top, bottom, way = 0, 0, 0
            for k in range(1, len(at)):
                if hi[k] > hi[top]:
                    top = k
                if lo[k] < lo[bottom]:
                    bottom = k
                if way >= 0 and lo[k] <= hi[top] * (1 - turn) and k > top:
                    rows.append((at[top], hi[top], "peak", at[k]))
                    way, bottom, top = -1, k, k
                elif way <= 0 and hi[k] >= lo[bottom] * (1 + turn) and k > bottom:
                    rows.append((at[bottom], lo[bottom], "trough", at[k]))
                    way, top, bottom = 1, k, k
        return pd.DataFrame([(*[bars[c].iloc[0] for c in key], *r) for r in rows], columns=[*key, "bar_idx", "price", "swing_type", "confirmation_index"])

    schema = POINT if key == ["symbol"] else POINT.replace("symbol string,", "symbol string, zone_id long,")
    return df.select(*key, "bar_idx", "high", "low", *own).groupBy(*key).applyInPandas(run, schema)


STRATEGIES = {"pivot_points": pivot_points, "find_peaks": peak_points, "zigzag": zigzag_points}


def linked(points: DataFrame, key: list[str] | None = None, ieee: bool = False) -> DataFrame:
    """point_id, amplitude_to_next (percent) and duration_to_next of each point; a bar's peak is before its trough. The
    amplitude from a price of zero is NULL or, if ieee, infinite or NaN."""
    key = key or ["symbol"]
    w = Window.partitionBy(*key).orderBy("bar_idx", "swing_type")
    nxt, at = F.lead("price").over(w), F.lead("bar_idx").over(w)
    return points.withColumns({
        "point_id": (F.row_number().over(w) - 1).cast("long"),
        "amplitude_to_next": (quotient(nxt, F.col("price"), ieee) - 1) * 100,
        "duration_to_next": (at - F.col("bar_idx")).cast("long"),
    })


def in_zones(points: DataFrame, zones: DataFrame, bin_bars: int = 1024) -> DataFrame:
    """Points of each zone with one neighbour before and one after: those whose next point is not before the
    zone's start and whose previous is not after its end. Zones and points meet by (symbol, bin of bars)."""
    w = Window.partitionBy("symbol").orderBy("bar_idx", "swing_type")
    p = points.withColumns({"__n": F.coalesce(F.lead("bar_idx").over(w), F.col("bar_idx") + 1), "__p": F.coalesce(F.lag("bar_idx").over(w), F.col("bar_idx") - 1)})
    p = p.withColumn("__n", F.greatest("__n", "bar_idx")).withColumn("__p", F.least("__p", "bar_idx"))
    p = p.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("__p") / bin_bars), F.floor(F.col("__n") / bin_bars))))
    z = zones.select("symbol", "zone_id", "type", "start_idx", "end_idx").withColumn("__bin", F.explode(F.sequence(F.floor(F.col("start_idx") / bin_bars), F.floor(F.col("end_idx") / bin_bars))))
    hit = p.join(z, ["symbol", "__bin"]).where((F.col("__n") >= F.col("start_idx")) & (F.col("__p") <= F.col("end_idx")))
    return hit.drop("__bin", "__n", "__p").dropDuplicates(["symbol", "zone_id", "bar_idx", "swing_type"])


def swing_metrics(points: DataFrame, min_amplitude_pct: float | DataFrame = 0.0, key: list[str] | None = None, ieee: bool = False) -> DataFrame:
    """Rallies and drops between consecutive points of each key: counts, sizes, durations, speeds and ratios; zero
    where there are none. Movements without duration, from price zero (unless ieee: they are infinite, or NaN and rallies)
    or too small are left out; what is too small may be a table with min_amplitude_pct for each symbol or zone."""
    key = key or ["symbol", "zone_id"]
    m = linked(points, key, ieee).where(F.col("duration_to_next").isNotNull() & (F.col("duration_to_next") > 0) & F.col("amplitude_to_next").isNotNull())
    m = m.withColumns({"a": F.abs("amplitude_to_next"), "d": F.col("duration_to_next"), "__up": F.col("amplitude_to_next") > 0})
    least = F.lit(min_amplitude_pct) if isinstance(min_amplitude_pct, (int, float)) else F.col("min_amplitude_pct")
    if not isinstance(min_amplitude_pct, (int, float)):
        m = m.join(min_amplitude_pct, [k for k in key if k in min_amplitude_pct.columns])
    m = m.where((F.col("a") >= least * 100) & (F.col("amplitude_to_next") != 0)).withColumn("v", F.col("a") / F.col("d"))
    parts = []
    for name, up in (("rally", True), ("drop", False)):
        own = lambda c: F.when(F.col("__up") == up, F.col(c))  # noqa: B023, E731
        zero = lambda x: F.coalesce(x, F.lit(0.0))
        parts += [
            F.count(own("a")).alias(f"{name}_count"), zero(F.avg(own("a"))).alias(f"avg_{name}_pct"), zero(F.max(own("a"))).alias(f"max_{name}_pct"), zero(F.min(own("a"))).alias(f"min_{name}_pct"),
            zero(F.when(F.count(own("a")) > 1, F.stddev_pop(own("a")))).alias(f"{name}_amplitude_std"), zero(F.median(own("a"))).alias(f"{name}_amplitude_median"),
            zero(F.avg(own("d"))).alias(f"avg_{name}_duration_bars"), F.coalesce(F.max(own("d")), F.lit(0)).alias(f"max_{name}_duration_bars"),
            zero(F.avg(own("v"))).alias(f"avg_{name}_speed_pct_per_bar"), zero(F.max(own("v"))).alias(f"max_{name}_speed_pct_per_bar"),
        ]
    out = m.groupBy(*key).agg(*parts)
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return out.withColumns({
        "rally_to_drop_ratio": ratio("avg_rally_pct", "avg_drop_pct"), "duration_symmetry": ratio("avg_rally_duration_bars", "avg_drop_duration_bars"),
        "num_swings": F.least("rally_count", "drop_count"),
    })


def with_auto_thresholds(df: DataFrame, strategy: str, key: list[str] | None = None, base: float = 0.01, **parameters) -> tuple[DataFrame, DataFrame]:
    """Points of a strategy whose threshold follows each key's prices, and (key, min_amplitude_pct), the least amplitude of a
    movement there. Zigzag turns by its deviation and peaks stand out by their prominence; pivots take the
    threshold as least amplitude, peaks too."""
    key = key or ["symbol"]
    limits = auto_thresholds(df, key, base)
    column = {"zigzag": "zigzag_deviation", "find_peaks": "peak_prominence", "pivot_points": "pivot_deviation"}[strategy]
    least = limits.select(*key, (F.lit(0.0) if strategy == "zigzag" else F.col(column)).alias("min_amplitude_pct"))
    if strategy == "pivot_points":
        return pivot_points(df, key=key, **parameters), least
    own = df.join(limits.select(*key, F.col(column).alias("__own")), key)
    return STRATEGIES[strategy](own, **parameters, **{"deviation" if strategy == "zigzag" else "prominence": "__own"}, key=key), least


def aggregate_by_type(features: DataFrame, types: tuple[str, ...] = ("bull", "bear")) -> DataFrame:
    """Swing figures of zones over all zones of each type: zones, those with figures, means and population deviations of
    sizes and durations, and how many zones each is of. A zone without rallies (drops) counts with its zeros, one
    whose figures are missing with none."""
    z = features.where(F.col("type").isin(*types))
    rally, drop, up, down = (F.col(c) for c in ("avg_rally_pct", "avg_drop_pct", "avg_rally_duration_bars", "avg_drop_duration_bars"))
    live = rally.isNotNull() | drop.isNotNull()
    n_up, n_down = F.count(up), F.count(down)
    # over rallies and drops together: from sums, as each zone gives up to two values
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    total, square = F.sum(zero(up) + zero(down)), F.sum(zero(up * up) + zero(down * down))
    mean = F.try_divide(total, n_up + n_down)
    parts = {"rally": rally, "drop": drop, "rally_duration": up, "drop_duration": down}
    # of one value, be it infinite, there is none
    deviation = lambda c: F.when(F.count(c) > 1, F.stddev_pop(c)).when(F.count(c) == 1, 0.0)
    return z.groupBy("type").agg(
        F.count(F.lit(1)).alias("zones"), F.count_if(live).alias("with_swings"),
        *[x for n, c in parts.items() for x in (F.avg(c).alias(f"avg_{n}_mean"), deviation(c).alias(f"avg_{n}_std"), F.count(c).alias(f"avg_{n}_samples"))],
        F.avg(F.when(live, F.col("rally_to_drop_ratio"))).alias("ratio_mean"),
        mean.alias("avg_duration_mean"), F.sqrt(F.greatest(F.try_divide(square, n_up + n_down) - mean * mean, F.lit(0.0))).alias("avg_duration_std"), (n_up + n_down).alias("avg_duration_samples"),
    )


def auto_thresholds(df: DataFrame, key: list[str] | None = None, base: float = 0.01) -> DataFrame:
    """Thresholds that follow the price range over the median close of each key, with a floor."""
    key = key or ["symbol"]
    a = df.groupBy(*key).agg((F.max("high") - F.min("low")).alias("__r"), F.coalesce(F.nullif(F.median("close"), F.lit(0.0)), F.avg("close")).alias("__c"))
    rel = F.coalesce(F.try_divide(F.col("__r"), F.col("__c")), F.lit(base))
    return a.select(*key, F.greatest(F.lit(base), rel * 0.5).alias("zigzag_deviation"), F.greatest(F.lit(base), rel * 0.3).alias("peak_prominence"), F.greatest(F.lit(base), rel * 0.25).alias("pivot_deviation"))

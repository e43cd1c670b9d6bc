"""The zone pipeline: bars to indicator to zones to features, as one lazy plan, and the statistics over them."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from tidewater.operators import describe, features, hypothesis, indicators, learning, sequences, swings, zones

#: The detection column of each basis of the MACD preset.
MACD_BASIS = {"line": "macd", "histogram": "macd_hist"}
TABLES = ("bars", "zones", "features")


@dataclass(frozen=True)
class Config:
    """What a pipeline does; the key of its results is the hash of this and of the input's version."""

    indicator: tuple[str, str, tuple] | None = None
    detector: str = "zero_crossing"
    rules: tuple = ()
    column: str = "macd"
    swing: str | None = "zigzag"
    swing_scope: str = "global"
    preset: str = "default"
    auto: bool = False
    divergence: bool = False
    volatility: bool = False
    volume: bool = True
    more: tuple = ()
    clusters: int | None = None
    regression: bool = False
    ieee: bool = False

    def key(self, version: str) -> str:
        return hashlib.sha256(json.dumps([version, repr(self)]).encode()).hexdigest()


@dataclass
class Result:
    """Lazy tables bars, zones and features; statistics are computed when asked for."""

    bars: DataFrame
    zones: DataFrame
    features: DataFrame
    config: Config
    memo: dict = field(default_factory=dict)

    def _once(self, name: str, make: Callable):
        if name not in self.memo:
            self.memo[name] = make()
        return self.memo[name]

    def distribution(self) -> DataFrame:
        return describe.zone_distribution(self.features)

    def transitions(self) -> DataFrame:
        return sequences.transitions(self.zones)

    def hypothesis_tests(self) -> dict:
        return self._once("tests", lambda: hypothesis.run_all(self.features))

    def clusters(self, k: int | None = None) -> DataFrame:
        return learning.cluster_zones(self.features, k or self.config.clusters or 3)

    def regressions(self) -> dict:
        return self._once("regressions", lambda: {"duration": learning.duration_regression(self.features), "return": learning.return_regression(self.features)})

    def save(self, path: str) -> None:
        """A directory of Parquet tables and the configuration; bars keep their zone, so nothing is lost."""
        for name in TABLES:
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        spark = self.bars.sparkSession
        spark.createDataFrame([(json.dumps(asdict(self.config)), json.dumps(self.memo, default=str))], "config string, statistics string").coalesce(1).write.mode("overwrite").json(f"{path}/metadata")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Result:
        """The tables, configuration and computed statistics that save() wrote."""
        r = spark.read.schema("config string, statistics string").json(f"{path}/metadata").first()
        tuples = lambda x: tuple(map(tuples, x)) if isinstance(x, list) else x
        config = Config(**{k: tuples(v) for k, v in json.loads(r["config"]).items()})
        return Result(*[spark.read.parquet(f"{path}/{name}") for name in TABLES], config, json.loads(r["statistics"]))


class ZoneAnalysis:
    """Collects settings; build() gives the plan.

    >>> analyze_zones(bars).with_indicator("custom", "macd").detect("zero_crossing", indicator="macd").build()
    """

    def __init__(self, bars: DataFrame, config: Config | None = None, rules: dict | None = None):
        self.bars, self.config, self.rules = bars, config or Config(), rules or {}

    def _with(self, rules: dict | None = None, /, **changes) -> ZoneAnalysis:
        return ZoneAnalysis(self.bars, replace(self.config, **changes), self.rules if rules is None else rules)

    def with_indicator(self, source: str, name: str, **parameters) -> ZoneAnalysis:
        return self._with(indicator=(source, name, tuple(sorted(parameters.items()))))

    def detect(self, strategy: str, column: str | None = None, **rules) -> ZoneAnalysis:
        return self._with(rules, detector=strategy, rules=tuple(sorted((k, str(v)) for k, v in rules.items())), column=column or rules.get("indicator") or self.config.column)

    def with_swings(self, strategy: str | None, scope: str = "global", preset: str = "default", auto: bool = False) -> ZoneAnalysis:
        """auto: thresholds follow the prices of each series (or zone) instead of the preset."""
        if preset not in swings.PRESETS or scope not in ("global", "per_zone"):
            raise ValueError("unknown preset or scope")
        return self._with(swing=strategy, swing_scope=scope, preset=preset, auto=auto)

    def with_strategies(self, divergence: bool = False, volatility: bool = False, volume: bool = True) -> ZoneAnalysis:
        return self._with(divergence=divergence, volatility=volatility, volume=volume)

    def with_features(self, family: str, name: str, **parameters) -> ZoneAnalysis:
        """Adds the columns of a registered feature strategy; those that are there already stay."""
        features.strategy(family, name)
        return self._with(more=(*self.config.more, (family, name, tuple(sorted(parameters.items())))))

    def analyze(self, clusters: int | None = None, regression: bool = False) -> ZoneAnalysis:
        return self._with(clusters=clusters, regression=regression)

    def with_division(self, ieee: bool) -> ZoneAnalysis:
        """Whether dividing by a price of zero gives infinities and NaN, as SQL's doubles do, or NULL."""
        return self._with(ieee=ieee)

    def build(self) -> Result:
        c, bars = self.config, self.bars
        if c.indicator:
            source, name, parameters = c.indicator
            bars = indicators.create(source, name, **dict(parameters))(bars)
        zoned = zones.detect(bars, c.detector, **self.rules)
        table = zones.zone_table(zoned)
        points, least, key = None, 0.0, ["symbol", "zone_id"]
        if c.swing:
            parameters = dict(swings.PRESETS[c.preset][c.swing])
            least = parameters.pop("min_amplitude_pct", 0.0)
            if c.auto:
                parameters = {k: v for k, v in parameters.items() if k not in ("deviation", "prominence")}
            if c.swing_scope == "global":
                points, least = swings.with_auto_thresholds(bars, c.swing, **parameters) if c.auto else (swings.STRATEGIES[c.swing](bars, **parameters), least)
        f = features.all_features(zoned, c.column, points, table, least, c.divergence, c.volatility, c.volume, c.ieee)
        if c.swing and c.swing_scope == "per_zone":
            own, least = swings.with_auto_thresholds(zoned, c.swing, key=key, **parameters) if c.auto else (swings.STRATEGIES[c.swing](zoned, key=key, **parameters), least)
            f = features.with_swing_metrics(f, swings.swing_metrics(own, least, ieee=c.ieee))
        for family, name, parameters in c.more:
            own = features.strategy(family, name)(zoned, c.column, **dict(parameters))
            f = f.join(own.select(*key, *[x for x in own.columns if x not in f.columns]), key, "left")
        return Result(zoned, table, f, c)

    def cached(self, root: str, version: str) -> Result:
        """The result kept under root for this configuration and version of the input; built and saved where there is none.
        What could not be written whole is not found again."""
        spark = self.bars.sparkSession
        path = f"{root.rstrip('/')}/{self.config.key(version)}"
        done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/metadata/_SUCCESS")
        if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
            self.build().save(path)
        return Result.load(spark, path)


def analyze_zones(bars: DataFrame) -> ZoneAnalysis:
    return ZoneAnalysis(bars)


def macd_zones(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, zone_basis: str = "line", min_duration: int = 2, **more) -> Result:
    column = MACD_BASIS[zone_basis]
    return analyze_zones(bars).with_indicator("custom", "macd", fast=fast, slow=slow, signal=signal).detect("zero_crossing", indicator=column, min_duration=min_duration).with_swings(more.get("swing", "pivot_points")).build()


def rsi_zones(bars: DataFrame, period: int = 14, upper: float = 70, lower: float = 30, min_duration: int = 2, **more) -> Result:
    return analyze_zones(bars).with_indicator("custom", "rsi", period=period).detect("threshold", column=f"rsi_{period}", indicator=f"rsi_{period}", upper=upper, lower=lower, min_duration=min_duration).with_swings(more.get("swing", "pivot_points")).build()


def ao_zones(bars: DataFrame, fast: int = 5, slow: int = 34, min_duration: int = 2, **more) -> Result:
    return analyze_zones(bars).with_indicator("custom", "ao", fast=fast, slow=slow).detect("zero_crossing", indicator=f"ao_{fast}_{slow}", min_duration=min_duration).with_swings(more.get("swing", "pivot_points")).build()


def preloaded_zones(bars: DataFrame, external: DataFrame, column: str, tolerance_seconds: int = 60, min_duration: int = 2, **more) -> Result:
    return analyze_zones(bars).detect("preloaded", column=column, zones=external, tolerance_seconds=tolerance_seconds, min_duration=min_duration).with_swings(more.get("swing", "pivot_points")).build()

"""Readers of price files and tables; each gives a lazy DataFrame with the canonical columns."""

from __future__ import annotations

import csv
import functools
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions.series import OHLC, no_nan
from tidewater.operators.bars import numbered

#: Date formats tried in turn, other names of columns, names of timeframes.
DATE_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy.MM.dd HH:mm:ss", "yyyy.MM.dd HH:mm", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd")
ALIASES = {"o": "open", "h": "high", "l": "low", "c": "close", "v": "volume", "vol": "volume", "adj close": "adj_close", "time": "ts", "date": "ts", "datetime": "ts", "timestamp": "ts"}
MINUTES, HOURS, MONTHS = (1, 2, 3, 4, 5, 6, 10, 12, 15, 20, 30, 45), (1, 2, 3, 4, 6, 8, 12), (1, 3, 6, 12)
TIMEFRAME_NAMES = {
    **{n: f"{m}m" for m in MINUTES for n in (str(m), f"M{m}", f"{m}m")}, **{n: f"{h}h" for h in HOURS for n in (str(60 * h), f"H{h}", f"{h}h")},
    **{n: "1d" for n in ("1d", "1D", "D1", "Daily")}, **{n: "1w" for n in ("1w", "1W", "W1", "Weekly")}, **{f"{m}M": f"{m}M" for m in MONTHS}, "Monthly": "1M", "MN1": "1M",
}
METATRADER = ("ts", "open", "high", "low", "close", "volume")
BOMS = ((b"\xef\xbb\xbf", "UTF-8"), (b"\xff\xfe", "UTF-16"), (b"\xfe\xff", "UTF-16"))
PROBE = 10_000
SPARK_NAMES = {"windows-1252": "ISO-8859-1"}


def files(spark: SparkSession, path: str) -> list[str]:
    """The files of a path, which may be a pattern or a folder, in order of name."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs, out = target.getFileSystem(conf), []
    for status in fs.globStatus(target) or []:
        inner = fs.listStatus(status.getPath()) if status.isDirectory() else [status]
        out += [x.getPath().toString() for x in inner if x.isFile() and not x.getPath().getName().startswith(("_", "."))]
    return sorted(out)


def head_of(spark: SparkSession, file: str, n: int = PROBE) -> bytes:
    """The first n bytes of a file, and no more, through Spark's file systems."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(target)
    try:
        return bytes(stream.readNBytes(n))
    finally:
        stream.close()


def detect_encoding(spark: SparkSession, path: str) -> str:
    """UTF-8, UTF-16 or windows-1252, from the first bytes of the first file."""
    found = files(spark, path)
    return encoding_of(head_of(spark, found[0]) if found else b"")


def encoding_of(data: bytes) -> str:
    for mark, name in BOMS:
        if data.startswith(mark):
            return name
    for cut in range(min(4, len(data) + 1)):  # the last character may be cut
        try:
            data[: len(data) - cut].decode("utf-8")
            return "UTF-8"
        except UnicodeDecodeError:
            continue
    return "windows-1252"


def parsed_time(column: str):
    """The first date format that fits, as a time stamp without zone."""
    return F.coalesce(*[F.try_to_timestamp(F.col(column), F.lit(f)) for f in DATE_FORMATS]).cast("timestamp_ntz")


def headerless(spark: SparkSession, path: str, encoding: str = "UTF-8") -> bool:
    """Whether the first line of the first file is data: six columns or more of which the second to the sixth are numbers."""
    found = files(spark, path)
    return bool(found) and is_data(first_line(head_of(spark, found[0]), encoding))


def first_line(data: bytes, encoding: str) -> list[str]:
    lines = data.decode(encoding, "ignore").lstrip("\ufeff").splitlines()
    return next(csv.reader(lines[:1]), []) if lines else []


def is_data(cells: list[str]) -> bool:
    """Whether a first line is a row of prices and no header."""
    if len(cells) < 6:
        return False

    def number(x: str | None) -> bool:
        try:
            float(x or "")
            return True
        except ValueError:
            return False

    return not number(cells[0]) and all(number(x) for x in cells[1:6])


def canonical_names(columns: list[str]) -> list[str]:
    """Lower case, without space around, with the usual names for aliases."""
    return [ALIASES.get(c.strip().lower(), c.strip().lower()) for c in columns]


def load_ohlcv(spark: SparkSession, path: str, symbol: str | None = None, timeframe: str | None = None, strict: bool = False, least_rows: int = 100) -> DataFrame:
    """(symbol, ts, bar_idx, open, high, low, close, volume, ...) of CSV files, with or without a header; the symbol
    is taken from the file name where none is given. Files are read by their own encoding and header: those that are
    alike in one scan. Rows without any value go. strict raises where a column is missing, rows are few, more
    than a tenth of a column is missing, or a price is not positive."""
    kinds: dict[tuple, list[str]] = {}
    for file in files(spark, path):
        head = head_of(spark, file)
        encoding = encoding_of(head)
        cells = first_line(head, encoding)
        kinds.setdefault((encoding, None if is_data(cells) else tuple(cells)), []).append(file)
    if not kinds:
        raise ValueError(f"no files: {path}")
    parts = [_load_alike(spark, some, encoding, header is None, symbol, timeframe) for (encoding, header), some in sorted(kinds.items(), key=str)]
    df = numbered(functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts))
    if strict:
        check_structure(df, least_rows)
    return df


def _load_alike(spark: SparkSession, some: list[str], encoding: str, bare: bool, symbol: str | None, timeframe: str | None) -> DataFrame:
    raw = spark.read.option("header", str(not bare).lower()).option("encoding", SPARK_NAMES.get(encoding, encoding)).csv(some)
    if encoding == "windows-1252":  # Spark reads Latin-1, from which it differs in some control characters
        there = {chr(b): bytes([b]).decode("windows-1252", "ignore") for b in range(0x80, 0xA0)}
        there = {k: v for k, v in there.items() if v}
        old, new = "".join(there), "".join(there.values())
        raw = raw.select(*[F.translate(f"`{c}`", old, new).alias(c.translate(str.maketrans(there))) for c in raw.columns])
    names = [*METATRADER[: len(raw.columns)], *[f"col_{k}" for k in range(6, len(raw.columns))]] if bare else canonical_names(raw.columns)
    df = raw.toDF(*names)
    if missing := [c for c in ("ts", *OHLC) if c not in names]:
        raise ValueError(f"columns missing: {missing}")
    numbers = [c for c in names if c != "ts"]
    df = df.select(F.lit(symbol).alias("symbol") if symbol else symbol_of_file().alias("symbol"), parsed_time("ts").alias("ts"), *[F.expr(f"try_cast(`{c}` AS double)").alias(c) for c in numbers])
    if "volume" not in names:
        df = df.withColumn("volume", F.lit(None).cast("double"))
    if timeframe:
        df = df.withColumn("timeframe", F.lit(normal_timeframe(timeframe)))
    return no_nan(df).dropna("all", subset=[c for c in numbers])


def check_structure(df: DataFrame, least_rows: int = 100, most_missing: float = 0.1) -> dict:
    """Raises ValueError with all faults; returns the counts. One aggregation."""
    n = F.count(F.lit(1)).alias("n")
    r = df.agg(n, *[F.count_if(F.col(c).isNull()).alias(f"{c}_missing") for c in OHLC], *[F.count_if(F.col(c) <= 0).alias(f"{c}_not_positive") for c in OHLC], F.count_if(F.col("high") < F.col("low")).alias("crossed")).first().asDict()
    faults = [f"{r['n']} rows"] if r["n"] < least_rows else []
    faults += [k for k, v in r.items() if k.endswith("_missing") and v > most_missing * max(1, r["n"])] + [k for k, v in r.items() if k.endswith("_not_positive") and v]
    if faults:
        raise ValueError("; ".join(faults))
    return r


def symbol_of_file():
    """Column: the symbol in names like PROVIDER_SYMBOL, 60.csv, SYMBOL_TF.csv or SYMBOLTF.csv."""
    name = F.regexp_replace(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1), "(%20| )", " ")
    base = F.regexp_replace(name, r"\.[^.]+$", "")
    with_provider = F.regexp_extract(base, r"^[A-Za-z0-9]+_([A-Za-z0-9]+),", 1)
    with_frame = F.regexp_extract(base, r"^([A-Za-z]+?)_?(?:[MHDWmhdw]?\d+[mhdwMHDW]?)$", 1)
    return F.upper(F.when(with_provider != "", with_provider).when(with_frame != "", with_frame).otherwise(base))


def parse_file_name(name: str) -> dict[str, str | None]:
    """provider, symbol and timeframe of a file name."""
    base = re.sub(r"\.[^.]+$", "", name.rsplit("/", 1)[-1])
    if m := re.match(r"^([A-Za-z0-9]+)_([A-Za-z0-9]+),\s*(\w+)$", base):
        return {"provider": m[1], "symbol": m[2].upper(), "timeframe": normal_timeframe(m[3])}
    if m := re.match(r"^([A-Za-z]+?)_?([MHDWmhdw]?\d+[mhdwMHDW]?)$", base):
        return {"provider": None, "symbol": m[1].upper(), "timeframe": normal_timeframe(m[2])}
    return {"provider": None, "symbol": base.upper(), "timeframe": None}


def normal_timeframe(name: str) -> str:
    """The usual name: as it is written (1m is a minute, 1M a month), or else whatever its case."""
    for n in (name, name.upper(), name.lower(), name.capitalize()):
        if n in TIMEFRAME_NAMES:
            return TIMEFRAME_NAMES[n]
    return name


def load_default(spark: SparkSession, root: str, symbol: str = "XAUUSD", timeframe: str = "1h") -> DataFrame:
    """The default instrument at an hour."""
    return load_symbol(spark, root, symbol, timeframe)


def load_settings(spark: SparkSession, path: str) -> dict:
    """Settings of a batch of analyses from a JSON file, or from YAML where a parser for it is installed."""
    text = head_of(spark, path, 1 << 24).decode("utf-8")
    if path.lower().endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError:
            raise ValueError("a YAML parser is not installed; use JSON") from None
        out = yaml.safe_load(text)
    else:
        out = json.loads(text)
    if not isinstance(out, dict):
        raise ValueError("settings must be a mapping")
    return out


def data_path(root: str, symbol: str, timeframe: str) -> str:
    """The folder of a symbol and timeframe in a partitioned table, so that a read of it opens nothing else."""
    return f"{root}/symbol={symbol.upper()}/timeframe={normal_timeframe(timeframe)}"


def load_symbol(spark: SparkSession, root: str, symbol: str, timeframe: str) -> DataFrame:
    """Bars of one symbol and timeframe of a table written by writers.write_bars (partitions are pruned)."""
    bars = spark.read.parquet(root)
    return bars.where((F.col("symbol") == symbol.upper()) & (F.col("timeframe") == normal_timeframe(timeframe)))


def load_directory(spark: SparkSession, folder: str) -> DataFrame:
    """All CSV files of a folder as one table; the symbol comes from each file's name."""
    return load_ohlcv(spark, f"{folder.rstrip('/')}/*.csv")


def catalog(bars: DataFrame) -> DataFrame:
    """(symbol, timeframe) pairs of a table of bars, sorted."""
    frame = F.col("timeframe") if "timeframe" in bars.columns else F.lit(None).cast("string")
    return bars.select("symbol", frame.alias("timeframe")).distinct().orderBy("symbol", "timeframe")


def compare_columns(a: DataFrame, b: DataFrame) -> dict[str, list[str]]:
    return {"common": [c for c in a.columns if c in b.columns], "only_first": [c for c in a.columns if c not in b.columns], "only_second": [c for c in b.columns if c not in a.columns]}


def external_zones(spark: SparkSession, source: DataFrame | str) -> DataFrame:
    """Zones made elsewhere: a DataFrame or a CSV with symbol, zone_id, type, start_time, end_time."""
    df = source if isinstance(source, DataFrame) else spark.read.option("header", "true").csv(source)
    if missing := [c for c in ("zone_id", "type", "start_time", "end_time") if c not in df.columns]:
        raise ValueError(f"columns missing: {missing}")
    kinds = dict(df.dtypes)
    time = lambda c: parsed_time(c) if kinds[c] == "string" else F.col(c).cast("timestamp_ntz")
    return df.withColumns({"zone_id": F.col("zone_id").cast("long"), "start_time": time("start_time"), "end_time": time("end_time")})


def from_records(spark: SparkSession, rows: list[dict], symbol: str | None = None) -> DataFrame:
    """Bars of records held in memory, such as a sample that comes with a program; what is no number or time becomes NULL."""
    if not rows:
        raise ValueError("no records")
    columns = [*dict.fromkeys(c for r in rows for c in r)]
    names = canonical_names(columns)
    if missing := [c for c in ("ts", *OHLC) if c not in names]:
        raise ValueError(f"columns missing: {missing}")
    text = spark.createDataFrame([tuple(None if r.get(c) is None else str(r[c]) for c in columns) for r in rows], T.StructType([T.StructField(n, T.StringType()) for n in names]))
    own = F.col("symbol") if "symbol" in names else F.lit(symbol)
    numbers = [n for n in names if n not in ("ts", "symbol")]
    return numbered(no_nan(text.select(own.alias("symbol"), parsed_time("ts").alias("ts"), *[F.expr(f"try_cast(`{c}` AS double)").alias(c) for c in numbers])))


SAMPLE = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("ts", T.TimestampNTZType()), *[T.StructField(c, T.DoubleType()) for c in (*OHLC, "volume")]])


def generated_sample(spark: SparkSession, symbols: tuple[str, ...] = ("XAUUSD",), bars: int = 1000, step_minutes: int = 60, seed: int = 42) -> DataFrame:
    """A random walk of bars for each symbol, made by Spark from a hash of (seed, symbol, bar), the same each time."""
    grid = spark.createDataFrame([(s,) for s in symbols], "symbol string").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(bars - 1))))
    unit = lambda n: (F.pmod(F.xxhash64(F.lit(seed + n), "symbol", "k"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    step = F.sqrt(-2 * F.ln(unit(1))) * F.cos(2 * F.pi() * unit(2)) * 10
    from pyspark.sql import Window

    w = Window.partitionBy("symbol").orderBy("k")
    close = 2000 + F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, 0))
    df = grid.withColumn("close", close).withColumn("open", F.coalesce(F.lag("close").over(w), F.lit(2000.0)))
    df = df.withColumns({"high": F.greatest("open", "close") + 5 + 15 * unit(3), "low": F.least("open", "close") - 5 - 15 * unit(4), "volume": 1000 + 9000 * unit(5)})
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return numbered(df.withColumn("ts", start + F.make_dt_interval(mins=F.col("k") * step_minutes)).select("symbol", "ts", *OHLC, "volume"))


class Samples:
    """A registry of named samples with attributes that they are found by."""

    def __init__(self) -> None:
        self.entries: dict[str, dict] = {}
        self.add("xauusd_1h", symbol="XAUUSD", timeframe="1h", source="generated", bars=1000, step_minutes=60)
        self.add("xauusd_15m", symbol="XAUUSD", timeframe="15m", source="generated", bars=1000, step_minutes=15)

    def add(self, name: str, **attributes) -> None:
        self.entries[name] = attributes

    def names(self) -> list[str]:
        return sorted(self.entries)

    def find(self, **wanted) -> list[str]:
        """Names whose attributes match all that is wanted, without regard to case."""
        same = lambda a, b: str(a).lower() == str(b).lower()
        return [n for n in self.names() if all(same(self.entries[n].get(k), v) for k, v in wanted.items() if v is not None)]

    def load(self, spark: SparkSession, name: str) -> DataFrame:
        if name not in self.entries:
            raise ValueError(f"unknown sample {name}")
        e = self.entries[name]
        return generated_sample(spark, (e["symbol"],), e["bars"], e["step_minutes"])

    def info(self, spark: SparkSession, name: str) -> DataFrame:
        """One row a column: values, missing, their share in percent, least, largest and mean."""
        df = self.load(spark, name)
        cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in (*OHLC, "volume")]
        rows = df.select(F.explode(F.array(*cells)).alias("s")).select("s.*")
        missing = F.count_if(F.col("x").isNull())
        return rows.groupBy("column").agg(F.count("x").alias("n"), missing.alias("missing"), F.round(missing / F.count(F.lit(1)) * 100, 2).alias("missing_pct"), F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"))

    def integrity(self, spark: SparkSession, name: str) -> dict:
        """Whether a sample has the rows it names, its columns, no broken bars and no repeated stamps."""
        from tidewater.operators.validation import valid_row

        df = self.load(spark, name)
        r = df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(~valid_row()).alias("broken"), F.countDistinct("symbol", "ts").alias("stamps")).first()
        missing = [c for c in ("symbol", "ts", *OHLC, "volume") if c not in df.columns]
        return {"rows": r["rows"], "broken": r["broken"], "missing_columns": missing, "whole": r["rows"] == r["stamps"] == self.entries[name]["bars"] and not r["broken"] and not missing}

    def compare(self, spark: SparkSession, a: str, b: str) -> dict:
        return compare_columns(self.load(spark, a), self.load(spark, b)) | {"attributes": {k: (self.entries[a].get(k), self.entries[b].get(k)) for k in {**self.entries[a], **self.entries[b]} if self.entries[a].get(k) != self.entries[b].get(k)}}

    def preview(self, spark: SparkSession, name: str, n: int = 5) -> DataFrame:
        return self.load(spark, name).where(F.col("bar_idx") < n)

"""Sinks: partitioned bars, tables in several formats, flattened results."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_bars(bars: DataFrame, root: str, timeframe: str | None = None, mode: str = "overwrite") -> None:
    """Parquet by symbol and timeframe, sorted by time in each file: later reads prune folders and row groups."""
    if timeframe:
        bars = bars.withColumn("timeframe", F.lit(timeframe))
    bars.repartition("symbol", "timeframe").sortWithinPartitions("symbol", "timeframe", "ts").write.mode(mode).partitionBy("symbol", "timeframe").parquet(root)


def save(df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite") -> None:
    """parquet, orc, json or csv; nested columns are flattened for csv."""
    if kind == "csv":
        flatten(df).write.mode(mode).option("header", "true").csv(path)
    elif kind in ("parquet", "json", "orc"):
        getattr(df.write.mode(mode), kind)(path)
    else:
        raise ValueError(f"unknown format {kind}")


def flatten(df: DataFrame, separator: str = ".") -> DataFrame:
    """Structs as columns named by their path; arrays and maps as JSON."""

    def walk(field: T.StructField, path: str, name: str):
        if isinstance(field.dataType, T.StructType):
            for f in field.dataType.fields:
                yield from walk(f, f"{path}.`{f.name}`", f"{name}{separator}{f.name}")
        elif isinstance(field.dataType, (T.ArrayType, T.MapType)):
            yield F.to_json(F.col(path)).alias(name)
        else:
            yield F.col(path).alias(name)

    return df.select(*[c for f in df.schema.fields for c in walk(f, f"`{f.name}`", f.name)])


def to_records(df: DataFrame, most: int = 100_000) -> list[dict]:
    """Rows as dicts on the driver; more rows than most are an error and are not cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; write them with save()")
    return [r.asDict(recursive=True) for r in rows]


def write_report(rows: DataFrame, path: str, kind: str = "json", title: str = "Report", most: int = 10_000) -> None:
    """A report, one row a series: json is written by Spark as a folder of lines, text and html as one row each in a text folder. A report of
    more than most rows is not for reading and is refused as text or html."""
    if kind == "json":
        rows.write.mode("overwrite").json(path)
        return
    if kind not in ("text", "html"):
        raise ValueError(f"unknown kind {kind}")
    found = to_records(rows, most)
    if kind == "text":
        parts = ["\n".join([f"{title}", *(f"  {k}: {'' if v is None else v}" for k, v in r.items())]) for r in found]
        page = "\n\n".join(parts)
    else:
        cells = lambda tag, values: "".join(f"<{tag}>{html.escape('' if v is None else str(v))}</{tag}>" for v in values)
        body = "".join(f"<tr>{cells('td', r.values())}</tr>" for r in found)
        page = f"<!doctype html><title>{html.escape(title)}</title><table><tr>{cells('th', rows.columns)}</tr>{body}</table>"
    rows.sparkSession.createDataFrame([(page,)], "value string").coalesce(1).write.mode("overwrite").text(path)

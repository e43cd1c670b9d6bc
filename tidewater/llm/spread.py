"""Joins in which one key may hold a large part of all rows, and filters by lists of wanted or dropped rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.storage import written

#: A key with more than one in PARTS of all rows is dealt over several tasks; there are fewer than PARTS such keys.
PARTS = 1000
#: Rows of a list, of some 64 bytes each, that every executor may get whole.
LISTED = 100_000
#: Bits of a filter for each id in it, bits of one of its rows, and its rows at most: 8 MB, however many ids there are.
BITS, ROW, ROWS = 16, 32_768, 2048


def joined(rows: DataFrame, table: DataFrame, keys: list[str], salt: Column, how: str = "inner", count: str = "copies") -> DataFrame:
    """rows joined to table, which has one row for each of its keys and how many of rows have it.

    The rows of a heavy key are dealt by salt (a hash of the row) over as many tasks as its share asks for, and
    its row of table is sent to each of these. The list of heavy keys, fewer than PARTS, is broadcast."""
    total = table.agg(F.sum(count)).first()[0] or 0
    tasks = F.ceil(F.col(count) * PARTS / F.lit(max(total, 1))).cast("int")
    heavy = table.where(F.col(count) * PARTS > total).select(*keys, tasks.alias("__tasks"))
    rows = rows.join(F.broadcast(heavy), keys, "left").withColumn("__salt", F.pmod(salt, F.coalesce("__tasks", F.lit(1))).cast("int")).drop("__tasks")
    table = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.greatest(tasks, F.lit(1)) - 1)))
    return rows.join(table, [*keys, "__salt"], how).drop("__salt")


def _places(key: Column) -> list[Column]:
    """The two bits of a key in its row of a filter."""
    return [F.pmod(F.xxhash64(key, F.lit(k)), F.lit(ROW)) for k in (1, 2)]


def _row(key: Column, rows: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(rows)).cast("int")


class Filter:
    """Bits of the keys in a table, small enough for every executor: those that may be in it are told from those that are not.
    Some 1.4 in 100 others pass, more when there are over 4 million keys; an exact join must follow."""

    def __init__(self, keys: DataFrame):
        key, n = F.col(keys.columns[0]), keys.count()
        self.kind, self.rows = keys.dtypes[0][1], min(ROWS, max(1, -(-n * BITS // ROW)))
        each = keys.select(_row(key, self.rows).alias("__row"), F.explode(F.array(*_places(key))).alias("__place"))
        self.bits = written(each.repartition("__row").groupBy("__row").agg(F.bitmap_construct_agg("__place").alias("__bits")), "filter")

    def _split(self, df: DataFrame, key: Column, how: str) -> DataFrame:
        key, on = key.cast(self.kind), self.bits["__row"]
        on = on == _row(key, self.rows)
        for place in _places(key):
            byte = F.conv(F.hex(F.substring(self.bits["__bits"], (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10)
            on = on & (F.getbit(byte.cast("long"), (place % 8).cast("int")) == 1)
        return df.join(F.broadcast(self.bits), on, how)

    def passed(self, df: DataFrame, key: Column) -> DataFrame:
        return self._split(df, key, "left_semi")

    def stopped(self, df: DataFrame, key: Column) -> DataFrame:
        return self._split(df, key, "left_anti")


def with_listed(docs: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """docs joined to wanted, a table, by key. A list of up to LISTED rows goes to every executor, of a longer one a filter, so that
    texts that are not wanted stay where they are, however many are."""
    if wanted.limit(LISTED + 1).count() <= LISTED:
        return docs.join(F.broadcast(wanted), key)
    return Filter(wanted.select(key)).passed(docs, docs[key]).join(wanted.hint("merge"), key)


def without(docs: DataFrame, gone: DataFrame, on: Column, key: Column) -> DataFrame:
    """The rows of docs that no row of gone meets; on: when they meet, only where key is equal to gone's first column (or both are
    null). A list of up to LISTED rows goes to every executor, so that no text is moved; of a longer one a filter goes, and only
    the texts that pass it move, to be joined."""
    gone = written(gone, "dropped")
    if gone.limit(LISTED + 1).count() <= LISTED:
        return docs.join(F.broadcast(gone), on, "left_anti")
    listed = Filter(gone.select(gone.columns[0]))
    return listed.stopped(docs, key).unionByName(listed.passed(docs, key).join(gone.hint("merge"), on, "left_anti"))

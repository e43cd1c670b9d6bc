"""Bounded-space online packing of tokenized documents into sequences.

Each partition keeps a fixed number of open windows. A document is cut into full windows; its rest goes to the
open window where it fits best. When it fits none, the fullest is topped up with the head of the rest, emitted
full, and the remainder is placed again. At the end of a partition the open windows are merged, cutting where
that fills one, so that a partition leaves less than one window. These leftovers, with their ids, are merged by
groups of partitions in a second step; only the last window of a group can need padding."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm import bytepairs
from tidewater.llm.textarrays import small_batches
from tidewater.storage import written

LENGTH = 2048
#: Windows that a partition keeps open.
OPEN = 16
#: Partitions whose leftovers are merged together: at most 256 x 2047 ids in one task.
GROUP = 256
END = np.array([1], dtype="<u4")
#: Sequence ids have the partition above these bits; merged groups come after all partitions.
BITS, MERGED = 32, 1 << 30


class Packer:
    """Places pieces (doc, start, ids, doc_tokens) into windows of length tokens; ids are arrays."""

    def __init__(self, length: int, most_open: int):
        self.length, self.most_open = length, most_open
        self.open: list[list] = []  # each [used, pieces]
        self.full: list[list] = []  # pieces of emitted windows

    def add(self, doc, start: int, ids: np.ndarray, total: int) -> None:
        whole = len(ids) // self.length * self.length
        for k in range(0, whole, self.length):
            self.full.append([(doc, start + k, ids[k : k + self.length], total)])
        if whole < len(ids):
            self._place(doc, start + whole, ids[whole:], total)

    def _place(self, doc, start: int, ids: np.ndarray, total: int) -> None:
        while True:
            best, room = None, self.length - len(ids)
            for w in self.open:
                if w[0] <= room and (best is None or w[0] > best[0]):
                    best = w
            if best is not None:
                best[0] += len(ids)
                best[1].append((doc, start, ids, total))
                if best[0] == self.length:
                    self._emit(best)
                return
            if len(self.open) < self.most_open:
                self.open.append([len(ids), [(doc, start, ids, total)]])
                return
            fullest = max(self.open, key=lambda w: w[0])
            head = self.length - fullest[0]
            fullest[1].append((doc, start, ids[:head], total))
            self._emit(fullest)
            start, ids = start + head, ids[head:]

    def _emit(self, window: list) -> None:
        self.open = [w for w in self.open if w is not window]
        self.full.append(window[1])

    def merge(self) -> list:
        """Merges the open windows into as few as hold them; returns the pieces of the one that is not full."""
        pieces = [p for w in sorted(self.open, key=lambda w: -w[0]) for p in w[1]]
        self.open, now, used = [], [], 0
        for doc, start, ids, total in pieces:
            while len(ids):
                take = min(len(ids), self.length - used)
                now.append((doc, start, ids[:take], total))
                start, ids, used = start + take, ids[take:], used + take
                if used == self.length:
                    self.full.append(now)
                    now, used = [], 0
        return now


LONGS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def _rows(windows: list, first: int, kind: pa.DataType, with_ids: bool | None = None) -> pa.RecordBatch:
    """The pieces of windows numbered from first; with a column of ids, null or not, unless with_ids is None."""
    pieces = [p for w in windows for p in w]
    n = np.fromiter((len(p[2]) for p in pieces), dtype=np.int64, count=len(pieces))
    counts = np.fromiter(map(len, windows), dtype=np.int64, count=len(windows))
    before = np.cumsum(n) - n
    offset = before - np.repeat(before[np.cumsum(counts) - counts], counts)
    crc = [zlib.crc32(p[2]) for p in pieces]
    longs = [[p[1] for p in pieces], n, crc, [p[3] for p in pieces], np.repeat(np.arange(first, first + len(windows)), counts), offset]
    columns = [pa.array([p[0] for p in pieces], kind), *(pa.array(x, pa.int64()) for x in longs)]
    if with_ids is not None:
        columns.append(pa.array([p[2].tobytes() for p in pieces] if with_ids else [None] * len(pieces), pa.binary()))
    return pa.RecordBatch.from_arrays(columns, names=["id", *LONGS, *(["ids"] if with_ids is not None else [])])


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, most_open: int = OPEN) -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    The ids of a document are those that the tokenizers library gives for its whole text, then 1; null text counts as empty and
    gives the id 1 alone. Rows that repeat an id are documents of their own. Each id of each document lies in one
    piece; offsets in a sequence have no gaps and start at 0. An empty table gives an empty result; other columns
    are ignored."""
    small_batches(docs.sparkSession)
    kinds = docs.sparkSession.sparkContext.broadcast(bytepairs.classes())  # 1.1 MB, fixed
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = ", ".join([f"id {kind}", *(f"{x} long" for x in LONGS)])

    def pack_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, first, own = Packer(length, most_open), TaskContext.get().partitionId() << BITS, None
        for b in batches:
            own = b.schema.field("id").type
            for doc, ids in zip(b.column("id").to_pylist(), bytepairs.token_ids(b.column("text"), vocabulary, kinds.value)):
                packer.add(doc, 0, np.concatenate([ids, END]), len(ids) + 1)
                if len(packer.full) >= 2000:
                    yield _rows(packer.full, first, own, False)
                    first, packer.full = first + len(packer.full), []
        rest = packer.merge()
        if packer.full:
            yield _rows(packer.full, first, own, False)
            first += len(packer.full)
        if rest:
            yield _rows([rest], first, own, True)

    pieces = written(rows.mapInArrow(pack_partition, f"{schema}, ids binary"), "pieces")

    def merge_group(left: pa.Table) -> pa.Table:
        packer, number = Packer(length, most_open), left.column("group")[0].as_py()
        left = left.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        columns = (left.column(c).to_pylist() for c in ("id", "start", "ids", "doc_tokens"))
        packer.open = [[0, [(d, s, np.frombuffer(i, dtype="<u4"), t)]] for d, s, i, t in zip(*columns)]
        last = packer.merge()
        return pa.Table.from_batches([_rows(packer.full + [last] * bool(last), (MERGED + number) << BITS, left.schema.field("id").type)])

    group = F.shiftright(F.shiftright("sequence_id", BITS), GROUP.bit_length() - 1)
    left = pieces.where("ids is not null").withColumn("group", group)
    merged = left.groupBy("group").applyInArrow(merge_group, schema)
    return pieces.where("ids is null").select("id", *LONGS).unionByName(merged).withColumnRenamed("id", id_col)

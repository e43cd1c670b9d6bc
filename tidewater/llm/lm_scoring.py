"""Cross-entropy difference of matched n-gram models.

A target model is counted on documents known to be wanted, a background model on all documents. Both have the
same vocabulary, all words of the corpus, the same order and the same smoothing, so that for each
word of a document the two losses differ by content alone; their mean difference is the document's score, the
lower the more like the target. Counts cover every document, word and pair of words.

Vocabulary and models grow with the corpus and are held nowhere as a whole. Documents are dealt to blocks by a hash
of their id; a block counts its distinct pairs and sends them, sorted and packed, to the parts of the pair table
(ranges of hashes). A part adds up its pairs over all blocks and sends each block the counts of the pairs it asked
for; words and contexts go the same way once the pairs are known. A block then scores its documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.textarrays import LOWER, mix, raw, slices, span_hashes, words

#: Bytes of text in a block, while there are many blocks; bytes in a block of a small table; blocks from which on they get larger.
BLOCK_BYTES, SMALL_BYTES, BLOCKS = 8 << 20, 1 << 16, 64
#: Blocks for each part of the tables of pairs and words, once there are more than BLOCKS.
BLOCKS_A_PART = 32
#: Distinct words that a task holds before it passes them on.
HELD = 1_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Stand for the start of a text and, where the vocabulary is limited, for all words outside it.
START, OTHER = (mix(np.array([k], dtype=np.uint64) + _BASE)[0] for k in (1, 2))
_ZSTD = pa.Codec("zstd", 1)


class _Sums:
    """Counts by key, passed on when there are many."""

    def __init__(self, names: list[str]):
        self.names, self.parts, self.size = names, [], 0

    def add(self, keys: np.ndarray, *counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append((keys, *counts))
        self.size += len(keys)
        if self.size >= HELD:
            self._squeeze()
            if self.size >= HELD // 2:
                yield from self.all()

    def _squeeze(self) -> None:
        if self.parts:
            columns = [np.concatenate(x) for x in zip(*self.parts)]
            keys, at = np.unique(columns[0], return_inverse=True)
            sums = [np.bincount(at, weights=c, minlength=len(keys)).astype(np.int64) for c in columns[1:]]
            self.parts, self.size = [(keys, *sums)], len(keys)

    def all(self) -> Iterator[pa.RecordBatch]:
        self._squeeze()
        for part in self.parts:
            for k in range(0, len(part[0]), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 200_000]) for c in part], names=self.names)
        self.parts, self.size = [], 0


def _hashes(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of texts: number of the first, hashes of all their words in lower case A-Z, words before each text."""
    data, at = raw(column)
    for i, j in slices(at):
        part = LOWER[data[at[i] : at[j]]]
        starts, ends, upto = words(part, at[i : j + 1] - at[i])
        yield i, span_hashes(part, starts, ends).view(np.int64), upto


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = _Sums(["word", "n"])
    for b in batches:
        for _, h, _ in _hashes(b.column("text")):
            keys, n = np.unique(h, return_counts=True)
            yield from sums.add(keys, n)
    yield from sums.all()


def _pack(x: np.ndarray) -> bytes:
    """Whole numbers by planes of bytes, so that small ones cost little; a length before them."""
    x = np.ascontiguousarray(x)
    planes = x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() if len(x) else b""
    return len(planes).to_bytes(8, "little") + (_ZSTD.compress(planes, asbytes=True) if planes else b"")


def _unpack(b: bytes, kind=np.int64) -> np.ndarray:
    size = int.from_bytes(b[:8], "little")
    if not size:
        return np.zeros(0, dtype=kind)
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(_ZSTD.decompress(b[8:], decompressed_size=size, asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(width, size // width).T).view(kind).ravel()


def _pack_keys(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_keys(b: bytes) -> np.ndarray:
    return np.cumsum(_unpack(b, np.uint64), dtype=np.uint64)


class _Block:
    """Words and distinct pairs of a block's documents."""

    def __init__(self, text, limited: np.ndarray | None):
        now, before, self.sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for _, h, upto in _hashes(text):
            h = h.view(np.uint64)
            if limited is not None:
                h = np.where(np.isin(h, limited), h, OTHER)
            b = np.empty_like(h)
            b[1:] = h[:-1]
            b[upto[:-1][upto[:-1] < upto[1:]]] = START
            now.append(h)
            before.append(b)
            self.sizes.append(np.diff(upto))
        now, before, self.sizes = (np.concatenate(x) for x in (now, before, self.sizes))
        self.keys, first, self.at = np.unique(mix(before * _BASE + now), return_index=True, return_inverse=True)
        self.now, self.before = now[first], before[first]


def _edges(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each part's range begins in sorted keys, and their end."""
    starts = np.array([(k << 64) // parts for k in range(parts)], dtype=np.uint64)
    return np.append(np.searchsorted(keys, starts), len(keys))


def _sent(block: int, keys: np.ndarray, parts: int, counts: list[np.ndarray]) -> pa.Table:
    """One row for each part: the block, its keys there and its counts, empty parts too."""
    at = _edges(keys, parts)
    cut = [*zip(at[:-1].tolist(), at[1:].tolist())]
    columns = [pa.array([block] * parts, pa.int64()), pa.array(range(parts), pa.int64()), pa.array([_pack_keys(keys[a:e]) for a, e in cut], pa.binary())]
    columns.append(pa.array([_pack(np.concatenate([c[a:e] for c in counts]).astype(np.int64)) for a, e in cut], pa.binary()))
    return pa.Table.from_arrays(columns, names=["block", "part", "keys", "counts"])


SENT = "block long, part long, keys binary, counts binary"
#: kind 0: pairs, with n, n_target and whether this block is the first that holds the pair. kind 1: words, with the six
#: sums, and for the whole part its number of words and the sums of their counts.
BACK = "block long, kind int, part long, counts binary, whole array<long>"


def _rows_by_block(t: pa.Table) -> list[tuple[int, np.ndarray, np.ndarray]]:
    rows = zip(t.column("block").to_pylist(), t.column("keys").to_pylist(), t.column("counts").to_pylist())
    return [(b, _unpack_keys(k), _unpack(c)) for b, k, c in sorted(rows, key=lambda r: r[0])]


def _added(rows: list, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys of all blocks, the place of the first of each, the place of each row's in them, sums."""
    keys, first, at = np.unique(np.concatenate([k for _, k, _ in rows]), return_index=True, return_inverse=True)
    columns = [np.concatenate([c.reshape(n, -1)[k] for _, _, c in rows]) for k in range(n)]
    return keys, first, at, [np.bincount(at, weights=c, minlength=len(keys)).astype(np.int64) for c in columns]


def _back(t: pa.Table, kind: int, rows: list, at: np.ndarray, values: list[np.ndarray], first: np.ndarray | None, whole: list[int]) -> pa.Table:
    ends = np.cumsum([len(k) for _, k, _ in rows])
    out, mine = [], np.zeros(len(at), dtype=np.int64)
    if first is not None:
        mine[first] = 1
    for (_, k, _), e in zip(rows, ends.tolist()):
        own = at[e - len(k) : e]
        out.append(_pack(np.concatenate([*(v[own] for v in values), *([mine[e - len(k) : e]] if first is not None else [])])))
    n = len(rows)
    part = t.column("part")[0].as_py()
    columns = [pa.array([b for b, _, _ in rows], pa.int64()), pa.array([kind] * n, pa.int32()), pa.array([part] * n, pa.int64()), pa.array(out, pa.binary()), pa.array([whole] * n, pa.list_(pa.int64()))]
    return pa.Table.from_arrays(columns, names=["block", "kind", "part", "counts", "whole"])


def _pair_sums(t: pa.Table) -> pa.Table:
    rows = _rows_by_block(t)
    _, first, at, sums = _added(rows, 2)
    return _back(t, 0, rows, at, sums, first, [])


def _word_sums(t: pa.Table) -> pa.Table:
    rows = _rows_by_block(t)
    keys, _, at, sums = _added(rows, 6)
    types = len(keys) - int(np.isin(keys, [START, OTHER]).sum())
    return _back(t, 1, rows, at, sums, None, [types, int(sums[4].sum()), int(sums[5].sum())])


def _joined(t: pa.Table, kind: int, n: int) -> list[np.ndarray]:
    """What the parts sent back of one kind, in the order of the block's sorted keys."""
    one = t.filter(pc.equal(t.column("kind"), kind)).sort_by("part")
    counts = [_unpack(c).reshape(n, -1) for c in one.column("counts").to_pylist()]
    return [*np.concatenate(counts, axis=1)] if counts else [np.zeros(0, dtype=np.int64)] * n


def _send_pairs(parts: int, sent):
    def run(docs: pa.Table, wanted: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _sent(0, np.zeros(0, np.uint64), parts, [np.zeros(0, np.int64)] * 2)[:0]
        b = _Block(docs.column("text"), sent and sent.value)
        target = pc.is_in(docs.column("id"), value_set=wanted.column("id").combine_chunks()).to_numpy().astype(bool)
        n = np.bincount(b.at, minlength=len(b.keys))
        return _sent(docs.column("block")[0].as_py(), b.keys, parts, [n, np.bincount(b.at, weights=np.repeat(target, b.sizes), minlength=len(b.keys))])

    return run


def _word_numbers(b: _Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted words of a block, and for each of its pairs the places of the word before and of the word."""
    keys, at = np.unique(np.concatenate([b.before, b.now]), return_inverse=True)
    return keys, at[: len(b.keys)], at[len(b.keys) :]


def _send_words(parts: int, sent):
    def run(docs: pa.Table, back: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _sent(0, np.zeros(0, np.uint64), parts, [np.zeros(0, np.int64)] * 6)[:0]
        b = _Block(docs.column("text"), sent and sent.value)
        keys, before, now = _word_numbers(b)
        n, t, mine = _joined(back, 0, 3)
        n, t, total = n * mine, t * mine, lambda at, x: np.bincount(at, weights=x, minlength=len(keys))  # each pair by its first block
        return _sent(docs.column("block")[0].as_py(), keys, parts, [total(before, n), total(before, n > 0), total(before, t), total(before, t > 0), total(now, n), total(now, t)])

    return run


def losses(pairs: np.ndarray, seen: np.ndarray, kinds: np.ndarray, single: np.ndarray, total: int) -> np.ndarray:
    """Minus the log probability of each pair's word after the word before, in nats: Witten-Bell interpolation of
    pairs with words that are counted once more each."""
    weight = np.where(seen > 0, kinds / np.maximum(seen + kinds, 1), 1.0)
    return -np.log(np.maximum((1 - weight) * pairs / np.maximum(seen, 1) + weight * (single + 1.0) / total, 1e-300))


def _score(sent):
    def run(docs: pa.Table, back: pa.Table) -> pa.Table:
        b = _Block(docs.column("text"), sent and sent.value)
        _, before, now = _word_numbers(b)
        n, t, _ = _joined(back, 0, 3)
        seen_n, kinds_n, seen_t, kinds_t, single_n, single_t = _joined(back, 1, 6)
        whole = back.filter(pc.equal(back.column("kind"), 1)).column("whole").to_pylist()
        types, all_n, all_t = (sum(x[k] for x in whole) for k in range(3))
        out = []
        for pairs, seen, kinds, single, total in ((t, seen_t, kinds_t, single_t, all_t), (n, seen_n, kinds_n, single_n, all_n)):
            loss = losses(pairs, seen[before], kinds[before], single[now], total + types + 1)[b.at]
            upto = np.concatenate([[0], np.cumsum(b.sizes)])
            out.append(np.diff(np.concatenate([[0], np.cumsum(loss)])[upto]) / np.maximum(b.sizes, 1))
        return pa.Table.from_arrays([docs.column("id"), pa.array(b.sizes), pa.array(out[0]), pa.array(out[1]), pa.array(out[0] - out[1])], names=["id", "n_words", "target_loss", "background_loss", "score"])

    return run


def cross_entropy_difference(docs: DataFrame, wanted: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int | None = None) -> DataFrame:
    """id, n_words, target_loss, background_loss, score for each row of docs: target less background loss.

    Words are what white space leaves, in lower case A-Z; the vocabulary has all of them, or with size the commonest so
    many, all others being one word. A null text counts as empty; a text without words has
    losses and score 0. Null ids are never wanted; repeated rows are counted and scored each; without any wanted row
    the target model is uniform. An empty table gives an empty result; other columns are ignored."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = base.schema["id"].dataType.simpleString()
    sent = None
    if size is not None:
        counted = base.select("text").mapInArrow(_count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
        top = counted.orderBy(F.desc("n"), "word").limit(size).collect()
        sent = spark.sparkContext.broadcast(np.sort(np.array([r["word"] for r in top], dtype=np.int64).view(np.uint64)))
    size_bytes = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(min(BLOCKS, size_bytes // SMALL_BYTES), size_bytes // BLOCK_BYTES, 1)
    parts = max(min(BLOCKS, blocks), blocks // BLOCKS_A_PART)
    block = lambda h: F.pmod(h, F.lit(blocks)).cast("long").alias("block")
    base = base.select("id", "text", block(F.when(F.col("id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("id"))))
    marked = wanted.select(F.col(id_col).cast(kind).alias("id")).where("id is not null").distinct().select("id", block(F.xxhash64("id")))
    # one plan, so that the exchange of the texts by block serves all three passes
    by_block = lambda other, f, schema: base.groupBy("block").cogroup(other.groupBy("block")).applyInArrow(f, schema)
    pairs = by_block(marked, _send_pairs(parts, sent), SENT).groupBy("part").applyInArrow(_pair_sums, BACK)
    found = by_block(pairs, _send_words(parts, sent), SENT).groupBy("part").applyInArrow(_word_sums, BACK)
    out = by_block(pairs.unionByName(found), _score(sent), f"id {kind}, n_words long, target_loss double, background_loss double, score double")
    return out.withColumnRenamed("id", id_col)

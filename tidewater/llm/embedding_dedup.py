"""Near-duplicate vectors by randomised-rotation binary codes.

A vector of unit length is rotated at random; its code is the signs of the rotated components, stored with its
correction factor, the inner product of the vector and its code. The other vector of a pair is rotated alike and
rounded to four bits a component, at random in an unbiased way, so that the estimate of their inner product is
unbiased and costs four bit counts. Its error is bounded with high probability by the factor; pairs whose bound
stays below the threshold are dismissed, all others are computed exactly in double precision.

Equal vectors are one, with a weight. Pairs are looked for in tables: in each, with its own directions, vectors meet that
agree in the signs along all of them. The number of signs follows the number of vectors so that buckets keep their size,
the number of tables follows from the recall asked for at the threshold. A pair counts in the first table where it meets.
Buckets above a block come together in blocks of which each pair is a task of its own. Codes and factors are made once a
vector and travel with it: where they can't decide, the vectors are at hand and no pair has to leave its task."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.links import components
from tidewater.llm.spread import joined
from tidewater.llm.textarrays import spans
from tidewater.storage import written

#: Vectors that share a bucket by chance, about; blocks of larger buckets.
BUCKET, BLOCK = 256, 1024
#: The chance that a pair exactly at the threshold meets in some table.
RECALL = 0.98
#: Width of the confidence bound; in multiples of the estimate's spread, which is at most 1 / sqrt(dimension - 1).
WIDTH = 5.0
LEVELS = 15
SEED = 90001


@functools.cache
def rotation(dim: int) -> np.ndarray:
    """The rotation that codes are made with."""
    return _orthonormal(dim, dim, 0)


@functools.lru_cache(maxsize=256)
def directions(dim: int, table: int, bits: int) -> np.ndarray:
    """Directions whose signs name the bucket of a vector in a table."""
    return _orthonormal(dim, min(bits, dim), table + 1)


def _orthonormal(dim: int, n: int, number: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([SEED, dim, number]).standard_normal((dim, n)))
    return np.ascontiguousarray((q * np.sign(np.diag(r))).T)


def tables_for(n: int, threshold: float) -> tuple[int, int]:
    """Signs of a bucket and number of tables for n vectors."""
    bits = max(4, min(32, math.ceil(math.log2(max(n, 1) / BUCKET)) if n else 4))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - RECALL) / math.log(1 - meet))


def _units(rows: list, dtype: str) -> np.ndarray:
    v = np.frombuffer(b"".join(rows), dtype=dtype).reshape(len(rows), -1).astype(np.float64)
    v = v / np.abs(v).max(1)[:, None]  # so that no square overflows or vanishes
    return v / np.linalg.norm(v, axis=1)[:, None]


def bucket_of(v: np.ndarray, table: int, bits: int) -> np.ndarray:
    signs = v @ directions(v.shape[1], table, bits).T > 0
    return signs @ (1 << np.arange(signs.shape[1], dtype=np.int64))


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    packed = np.packbits(bits, axis=1)
    pad = -packed.shape[1] % 8
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, pad)))).view(np.uint64)


def coded(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and correction factors of the unit vectors v."""
    y = v @ rotation(v.shape[1]).T
    return _words(y > 0), np.abs(y).sum(1) / math.sqrt(v.shape[1])


class Codes:
    """Stored codes and factors, and rounded rotations of the unit vectors v."""

    def __init__(self, v: np.ndarray, code: np.ndarray, factor: np.ndarray):
        self.dim, self.code, self.factor = v.shape[1], code, factor
        y = v @ rotation(self.dim).T
        self.ones = np.bitwise_count(self.code).sum(1).astype(np.float64)
        self.low = y.min(1)
        self.step = np.maximum((y.max(1) - self.low) / LEVELS, 1e-12)
        dither = np.random.default_rng(SEED).random(y.shape)
        level = np.clip(np.floor((y - self.low[:, None]) / self.step[:, None] + dither), 0, LEVELS).astype(np.uint8)
        self.planes = [_words(level >> k & 1 > 0) for k in range(4)]
        self.level_sum = level.sum(1).astype(np.float64)
        self.bound = WIDTH * np.sqrt(np.maximum(1 - self.factor**2, 0)) / self.factor / math.sqrt(max(self.dim - 1, 1))

    def estimates(self, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products of the codes of columns with the rounded vectors of rows, and their bounds."""
        code = self.code[columns]
        both = np.zeros((len(rows), len(columns)))
        for k, plane in enumerate(self.planes):
            p = plane[rows]
            for w in range(code.shape[1]):
                both += np.bitwise_count(p[:, w : w + 1] & code[None, :, w]).astype(np.float64) * (1 << k)
        low, step = self.low[rows][:, None], self.step[rows][:, None]
        # sum over components of sign * (low + step * level)
        value = low * (2 * self.ones[columns] - self.dim)[None, :] + step * (2 * both - self.level_sum[rows][:, None])
        rounding = WIDTH * step / 2 / self.factor[columns][None, :]
        return value / math.sqrt(self.dim) / self.factor[columns][None, :], self.bound[columns][None, :] + rounding


def links_in(v: np.ndarray, codes: Codes, table: int, threshold: float, bits: int, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the unit vectors v with a cosine of threshold or more that meet in no earlier table; with side,
    only those between different sides."""
    g, a, b = len(v), [], []
    for r in range(0, g, 128):
        rows, columns = np.arange(r, min(r + 128, g)), np.arange(r, g)
        value, bound = codes.estimates(rows, columns)
        maybe = value + bound >= threshold
        maybe &= columns[None, :] > rows[:, None]
        if side is not None:
            maybe &= side[rows][:, None] != side[columns][None, :]
        x, y = np.nonzero(maybe)
        x, y = rows[x], columns[y]
        for k in range(0, len(x), 65536):
            i, j = x[k : k + 65536], y[k : k + 65536]
            exact = np.einsum("ij,ij->i", v[i], v[j]) >= threshold
            a.append(i[exact])
            b.append(j[exact])
    none = np.zeros(0, dtype=np.int64)
    x, y = (np.concatenate(a), np.concatenate(b)) if a else (none, none)
    if table and len(x):
        linked, at = np.unique(np.concatenate([x, y]), return_inverse=True)
        i, j, fresh = at[: len(x)], at[len(x) :], np.ones(len(x), dtype=bool)
        for t in range(table):
            before = bucket_of(v[linked], t, bits)
            fresh &= before[i] != before[j]
        x, y = x[fresh], y[fresh]
    return x, y


def _entries(dtype: str, bits: int, tables: int):
    names = ["id", "weight", "vec", "code", "factor", "dim", "t", "bucket"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column("vec").to_pylist()
            by_dim: dict[int, list[int]] = {}
            for k, r in enumerate(raw):
                by_dim.setdefault(len(r), []).append(k)
            for own in by_dim.values():
                some = b.take(pa.array(own))
                v = _units([raw[k] for k in own], dtype)
                code, factor = coded(v)
                fixed = [some.column("id"), some.column("weight"), some.column("vec"), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(factor)]
                n = len(own)
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([*fixed, pa.array([v.shape[1]] * n, pa.int32()), pa.array([t] * n, pa.int32()), pa.array(bucket_of(v, t, bits), pa.int64())], names=names)

    return run


def _pairs(dtype: str, bits: int, threshold: float):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])
    held = ("id", "weight", "vec", "code", "factor", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if len(rows) < 2:
                return
            ids, weights, vecs, code, factor, chunks = zip(*rows)
            own, weight = np.array(ids, dtype=np.int64), np.array(weights, dtype=np.int64)
            side = np.array(chunks) if now[3] != now[4] else None
            v = _units(vecs, dtype)
            codes = Codes(v, np.frombuffer(b"".join(code), dtype=np.uint64).reshape(len(rows), -1), np.array(factor))
            x, y = links_in(v, codes, now[1], threshold, bits, side)
            other = own[x] != own[y]
            x, y = x[other], y[other]
            if not len(x):
                return
            n = np.bincount(x, weights=weight[y], minlength=len(own)) + np.bincount(y, weights=weight[x], minlength=len(own))
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(own[some]), pa.nulls(len(some), pa.int64()), pa.array(n[some].astype(np.int64))], schema=schema)
            label = np.arange(len(own))
            tree = []
            for i, j in zip(x.tolist(), y.tolist()):
                if label[i] != label[j]:
                    tree.append((i, j))
                    label[label == label[j]] = label[i]
            i, j = np.array(tree).T
            yield pa.RecordBatch.from_arrays([pa.array(own[i]), pa.array(own[j]), pa.array(np.zeros(len(i), dtype=np.int64))], schema=schema)

        for b in batches:
            keys = [*zip(*(b.column(c).to_pylist() for c in ("dim", "t", "bucket", "i", "j")))]
            for key, row in zip(keys, zip(*(b.column(c).to_pylist() for c in held))):
                if key != now:
                    yield from done()
                    now, rows = key, []
                rows.append(row)
        yield from done()

    return run


def _bytes(dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            some = b.filter(pc.and_(pc.is_valid(b.column("id")), pc.greater(pc.fill_null(pc.list_value_length(b.column("v")), 0), 0)))
            v = some.column("v")
            x = np.ascontiguousarray(v.flatten().to_numpy(zero_copy_only=False), dtype=dtype)  # a missing component is no number
            at = np.concatenate([[0], np.cumsum(pc.list_value_length(v).to_numpy(zero_copy_only=False))]).astype(np.int64)
            good = np.zeros(0, dtype=bool)
            if len(some):
                good = np.logical_and.reduceat(np.isfinite(x), at[:-1]) & (np.maximum.reduceat(np.nan_to_num(np.abs(x)), at[:-1]) > 0)
            vec = spans(x.view(np.uint8), at * x.itemsize).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([some.column("id"), vec], names=["id", "vec"]).filter(pa.array(good, pa.bool_()))

    return run


def embedding_links(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, n_links, component_id, kept for each row of vectors.

    Links: pairs of rows of different ids with a cosine of threshold or more; none below is linked, and pairs at
    the threshold are found with a chance of RECALL or more, closer ones sooner. Vectors that are null, empty, zero or
    hold null or non-finite components link with nothing, nor do those of a null id, or of another length. Rows
    that repeat an id share their links: those of each of its different vectors add up. An empty table gives an empty result; other
    columns are ignored."""
    kind = vectors.schema[vector_col].dataType.elementType.simpleString()
    dtype = "<f4" if kind == "float" else "<f8"
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    if dtype == "<f8":
        base = base.withColumn("v", F.col("v").cast("array<double>"))
    # equal vectors are one; an id that has several vectors is not merged with others, as it must not link with itself
    good = written(base.mapInArrow(_bytes(dtype), "id long, vec binary").distinct(), "vectors")
    several = good.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", F.col("id").alias("alone"))
    good = good.join(several, "id", "left")
    classes = good.groupBy("vec", "alone").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight"))
    classes = written(classes.select("id", "vec", "weight", "alone"), "vector-classes")
    member = joined(good.withColumn("__own", F.coalesce("alone", F.lit(-1))), classes.select("vec", F.coalesce("alone", F.lit(-1)).alias("__own"), F.col("id").alias("class"), "weight"), ["vec", "__own"], F.xxhash64("id"), count="weight")
    member = written(member.select("id", "class", "weight").distinct(), "vector-members")
    bits, tables = tables_for(classes.count(), threshold)
    entries = classes.select("id", "weight", "vec").mapInArrow(_entries(dtype, bits, tables), "id long, weight long, vec binary, code binary, factor double, dim int, t int, bucket long")
    place = ["dim", "t", "bucket"]
    many = entries.groupBy(*place).agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    many = many.withColumn("chunks", F.ceil(F.col("size") / F.lit(BLOCK)).cast("int"))
    met = entries.join(many, place)
    met = met.withColumn("chunk", F.pmod(F.xxhash64("id", "vec"), F.col("chunks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    met = met.select("id", "weight", "vec", "code", "factor", *place, "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
    key = [*place, "i", "j"]
    found = met.repartition(*key).sortWithinPartitions(*key).mapInArrow(_pairs(dtype, bits, threshold), "a long, b long, n long")
    found = written(found, "vector-links")
    counts = found.where("b is null").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("n_links"))
    roots = components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "class")
    own = member.join(counts, "class", "left").join(roots, "class", "left")
    own = own.groupBy("id").agg(F.max(F.col("weight") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links"), F.min(F.coalesce("root", "class")).alias("root"))
    rows = base.select("id").join(own, "id", "left")
    component = F.coalesce("root", "id")
    return rows.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))

"""Quality scores from a regularised quadratic discriminant over transformed document statistics.

Each class has a mean and a covariance of the statistics, shrunk towards its diagonal and towards a multiple of
the identity. A score is the logistic function of the difference of the two Gaussian log densities plus the log
prior; the densities use the Cholesky factors of the covariances, made once and sent to all tasks. Means and
covariances come from sums over all labelled training rows, so no row is sampled and the driver gets two small
matrices whatever the input."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.textarrays import IS_SPACE, raw, slices, small_batches, span_hashes, words
from tidewater.storage import written

#: Weight of the diagonal and of the scaled identity in a class covariance.
TO_DIAGONAL, TO_IDENTITY = 0.10, 0.01
THRESHOLD = 0.7

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_PLAIN = np.zeros(256, dtype=bool)
_PLAIN[[ord(c) for c in ".,;:!?'\"()-"]] = True
_ODD = ~(_LETTER | _DIGIT | _PLAIN | IS_SPACE)
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".!?"]] = True

FEATURES = (
    "log_words", "mean_word", "var_word", "odd", "digits", "plain", "upper", "lines", "distinct", "repeats",
    "same_next", "lone_odd", "odd_ends", "stops", "long_words", "capitals",
)


def _logit(share: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Smoothed log odds of a share; near normal where the share itself is skewed."""
    return np.log((share + 0.5) / (np.maximum(of - share, 0) + 0.5))


def statistics(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text; an empty text has the values of no words."""
    n_bytes = np.diff(at).astype(float)
    count = lambda table: np.diff(np.concatenate([[0], np.cumsum(table[data])])[at]).astype(float)
    starts, ends, upto = words(data, at)
    n = np.diff(upto).astype(float)
    of = np.repeat(np.arange(len(n)), np.diff(upto))
    per = lambda x: np.bincount(of, weights=x, minlength=len(n))
    some = np.maximum(n, 1)
    size = (ends - starts).astype(float)
    mean = per(size) / some
    spread = np.sqrt(np.maximum(per(size**2) / some - mean**2, 0))
    hashes = span_hashes(data, starts, ends)
    order = np.lexsort((hashes, of))
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (of[order][1:] != of[order][:-1])
    distinct = np.bincount(of[order], weights=fresh, minlength=len(n))
    # the count of each text's commonest word
    first = np.flatnonzero(fresh)
    runs = np.diff(np.append(first, len(order)))
    most = np.zeros(len(n))
    np.maximum.at(most, of[order][first], runs)
    again = np.zeros(len(of), dtype=bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    ends_odd, lone = _ODD[data[ends - 1]] if len(ends) else np.zeros(0), None
    lone = (ends - starts == 1) & (_ODD[data[starts]] if len(starts) else False)
    lines = count(np.arange(256) == 10)
    return np.column_stack([
        np.log1p(n), np.log1p(mean), np.log1p(spread), _logit(count(_ODD), n_bytes), _logit(count(_DIGIT), n_bytes),
        _logit(count(_PLAIN), n_bytes), _logit(count(_UPPER), n_bytes), _logit(lines, n_bytes), _logit(distinct, n),
        _logit(most, n), _logit(per(again), n), _logit(per(lone), n), _logit(per(ends_odd), n),
        _logit(per(_STOP[data[ends - 1]] if len(ends) else np.zeros(0)), n), _logit(per(size > 20), n),
        _logit(per(_UPPER[data[starts]] if len(starts) else np.zeros(0)), n),
    ])


def _features(texts: pa.Array) -> np.ndarray:
    data, at = raw(texts)
    rows = [statistics(data[at[i] : at[j]], at[i : j + 1] - at[i]) for i, j in slices(at)]
    return np.vstack(rows) if rows else np.zeros((0, len(FEATURES)))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x): the statistics of each text, 64 bytes a document, so that labels are joined to these and no text
    is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _features(b.column("text")).astype(np.float32)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([b.column("id"), flat], names=["id", "x"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, x array<float>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(FEATURES)).astype(np.float64)


def fit(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> dict:
    """Class means, shrunk covariances and priors from all rows of measured() that labels marks 0 or 1.

    A null or other label is no label; an id labelled twice with different values is none either. Raises ValueError
    unless both classes have at least two rows."""
    marks = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("lo"), F.max(label_col).alias("hi"))
    marks = marks.where("lo = hi").select("id", F.col("lo").cast("int").alias("label"))
    known = rows.join(marks, "id").select("x", "label")
    d = len(FEATURES)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for b in batches:
            x, y = _matrix(b.column("x")), b.column("label").to_numpy(zero_copy_only=False)
            for k in (0, 1):
                own = x[y == k]
                total[k] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_pydict({"label": [0, 1], "total": list(total)}, schema=pa.schema([("label", pa.int32()), ("total", pa.list_(pa.float64()))]))

    parts = known.mapInArrow(sums, "label int, total array<double>")
    parts = parts.select("label", F.posexplode("total").alias("k", "v")).groupBy("label", "k").agg(F.sum("v").alias("v"))
    total = np.zeros((2, 1 + d + d * d))
    for r in parts.collect():  # 2 (1 + d + d^2) numbers, whatever the input
        total[r["label"], r["k"]] = r["v"]
    if min(total[:, 0]) < 2:
        raise ValueError("both classes need at least two labelled rows")
    return {k: _class(total[k], d) for k in (0, 1)} | {"prior": float(np.log(total[1, 0] / total[0, 0]))}


def _class(total: np.ndarray, d: int) -> dict:
    n, mean = total[0], total[1 : d + 1] / total[0]
    cov = total[d + 1 :].reshape(d, d) / n - np.outer(mean, mean)
    cov = (1 - TO_DIAGONAL) * cov + TO_DIAGONAL * np.diag(np.diag(cov))
    cov = (1 - TO_IDENTITY) * cov + (TO_IDENTITY * np.trace(cov) / d + 1e-9) * np.eye(d)
    factor = np.linalg.cholesky(cov)
    return {"mean": mean, "whiten": np.linalg.inv(factor), "log_det": 2 * float(np.log(np.diag(factor)).sum())}


def scores(x: np.ndarray, model: dict) -> np.ndarray:
    """The probability of label 1 for each row of statistics."""
    density = [-0.5 * (((x - model[k]["mean"]) @ model[k]["whiten"].T) ** 2).sum(1) - 0.5 * model[k]["log_det"] for k in (0, 1)]
    return 1 / (1 + np.exp(-np.clip(density[1] - density[0] + model["prior"], -500, 500)))


def score(docs: DataFrame, model: dict, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with the column out, which none of its own may be named like; a null text is scored as empty. The score sees nothing
    but the text: rows with a null or repeated id are scored like any other, and an empty table stays empty."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    names = [f"c{k}" for k in range(len(docs.columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, len(b), 1000):  # texts stay in Arrow; few at a time
                part = b.slice(k, 1000)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores(_features(part.column(at)), sent.value))], names=[*names, "score"])

    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema.fields))
    return docs.toDF(*names).mapInArrow(run, f"{schema}, score double").toDF(*docs.columns, out)


def held_out(id_col: str = "doc_id"):
    """Column: the row is kept from training."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted for each row of docs; learnt from the rows that are not held out.

    A null text counts as empty. A row with a null id is scored, never held out and never learnt from; rows that repeat an id
    are scored each, and learnt from each where the id is labelled. An empty table of documents gives an empty
    result; other columns are ignored, whatever their names."""
    rows = written(measured(docs, id_col, text_col), "document-statistics")
    if rows.isEmpty():
        return rows.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    sent = docs.sparkSession.sparkContext.broadcast(fit(rows.where(~held_out("id")), labels, id_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(scores(_matrix(b.column("x")), sent.value))], names=["id", "score"])

    got = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double")
    return got.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

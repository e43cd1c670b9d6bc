"""Texts of an Arrow batch as flat numpy arrays: words, 64-bit hashes of spans, word shingles.

All functions work on the UTF-8 bytes of several texts laid end to end, with the texts' offsets, so that the
cost of Python is paid once a slice and not once a word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import SparkSession

#: Bytes of text that are worked on at once; a longer single text is taken whole.
SLICE_BYTES = 1 << 19

#: The white space of the word pattern [^\x20\x09-\x0D]+.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACES)] = True
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


#: Rows of an Arrow batch between Spark and Python.
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Sends texts to Python in batches of BATCH_ROWS rows or fewer: both sides hold a batch, and texts may be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


#: Bytes that are hashed together, and so the powers that are kept; sums of bytes times powers below 2^31 stay below 2^64.
WINDOW = 1 << 20
#: The largest primes below 2^31; bases drawn once.
PRIMES, BASES = (2147483647, 2147483629), (1277903537, 862413029)
_known = [[np.zeros(0, dtype=np.uint32)] * 2 for _ in PRIMES]


def raw(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and n + 1 offsets; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, ends, data = texts.buffers()
    at = np.frombuffer(ends, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def slices(at: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of texts with at most that many bytes, or one text."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def valid(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts as they are if their bytes are UTF-8, or with marks of replacement where they aren't."""
    if not (data & 0x80).any():
        return data, at
    try:
        data.tobytes().decode("utf-8")
        return data, at
    except UnicodeDecodeError:
        texts = [data[a:e].tobytes().decode("utf-8", "replace").encode() for a, e in zip(at[:-1].tolist(), at[1:].tolist())]
        return np.frombuffer(b"".join(texts), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])


def spans(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """The bytes between neighbouring offsets (the first 0) as a binary array."""
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at, dtype=np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a large binary array without nulls."""
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the number of words in the texts before it (n + 1)."""
    inside = ~IS_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = at[:-1][at[:-1] < at[1:]]
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = at[1:][at[:-1] < at[1:]] - 1
    last[tails] = inside[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, at)


def _powers(k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the k-th base and of its inverse modulo the k-th prime."""
    if len(_known[k][0]) < n:
        n = min(max(n, SLICE_BYTES), WINDOW) + 1
        for which, b in enumerate((BASES[k], pow(BASES[k], -1, PRIMES[k]))):
            out = np.ones(1, dtype=np.uint64)
            while len(out) < n:
                out = np.concatenate([out, out * np.uint64(pow(b, len(out), PRIMES[k])) % np.uint64(PRIMES[k])])
            _known[k][which] = out[:n].astype(np.uint32)
    return _known[k]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the spans, which lie apart and in order: two polynomials modulo primes; equal bytes give
    equal hashes wherever they stand. Spans of more than WINDOW bytes are hashed by xxh3."""
    out = np.zeros(len(starts), dtype=np.uint64)
    long = np.flatnonzero(ends - starts > WINDOW)
    for k in long.tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]].tobytes())
    i = 0
    while i < len(starts):
        if ends[i] - starts[i] > WINDOW:
            i += 1
            continue
        first = int(starts[i])
        j = int(np.searchsorted(ends, first + WINDOW, side="right"))
        a, e = starts[i:j] - first, ends[i:j] - first
        part = data[first : int(ends[j - 1])].astype(np.uint64) + np.uint64(1)
        h = np.zeros(j - i, dtype=np.uint64)
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        for k, p in enumerate(PRIMES):
            up, down = _powers(k, len(part) + 1)
            np.cumsum(part * up[: len(part)], out=total[1:])
            h = h << np.uint64(32) | (total[e] - total[a]) % np.uint64(p) * down[a] % np.uint64(p)
        out[i:j] = mix(h ^ (e - a).astype(np.uint64) * _BASE)
        i = j
    return out


def shingle_sets(data: np.ndarray, at: np.ndarray, n: int) -> list[np.ndarray]:
    """For each text its distinct n-word shingles as sorted 64-bit hashes, A-Z in lower case; a text with fewer
    words gives its whole word sequence as one, a text without words the empty set."""
    data = LOWER[data]
    starts, ends, upto = words(data, at)
    one = span_hashes(data, starts, ends)
    many = one.copy()
    for k in range(1, min(n, len(one))):
        many[: len(one) - k] = mix(many[: len(one) - k] * _BASE + one[k:])
    out = []
    for a, b in zip(upto[:-1].tolist(), upto[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(many[a : b - n + 1]))
        elif b > a:
            x = one[a : a + 1]
            for k in range(a + 1, b):
                x = mix(x * _BASE + one[k : k + 1])
            out.append(mix(x + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out

"""Substring deduplication by content-defined chunking with a gear rolling hash.

A gear hash runs over the bytes of a text; a chunk ends after white space where the hash of the bytes before it
has its top bits clear, and so it does, with more bits, after any character in a long run without white space. So equal
passages fall into equal chunks wherever they stand, whatever was inserted before them, in any script. Chunks are deduplicated by their 64-bit digest: the document with the smallest id that holds a chunk owns it, and
runs of chunks that other documents own are removed if they are long enough to be a passage; one chance collision
of digests is no such run. Only the
occurrences of chunks that several documents hold travel further than the count of digests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.spread import joined
from tidewater.llm.textarrays import IS_SPACE, raw, slices, small_batches, span_hashes
from tidewater.storage import written

#: A place after white space ends a chunk if the top bits of the hash are clear: on average every fourth does.
TOP_BITS = 2
#: Bytes: a chunk has at least LEAST unless its text ends, and is cut after MOST wherever a character starts.
LEAST, MOST = 16, 512
#: Bytes without white space from which on a chunk may end after any character, and the top bits that are clear there.
UNSPACED, UNSPACED_BITS = 48, 5
#: Words that a run of foreign chunks has at least to be removed. A passage of 50 words loses at most the partial
#: chunks at its two ends, which hold some six words each.
LEAST_WORDS = 25
#: A word of more than WORD bytes (unspaced scripts, encoded lines) counts as one for each PART bytes.
WORD, PART = 24, 12

_GEAR = np.random.default_rng(77).integers(0, 2**32, 256, dtype=np.uint32)


def gear_hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The gear hash after each byte: h = (h << 1) + gear[byte] in 32 bits, so of the last 32 bytes; each text starts
    anew, as if nothing were before it."""
    place = np.arange(len(data)) + np.repeat(31 * np.arange(1, len(at)), np.diff(at))
    h = np.zeros(len(data) + 31 * len(at), dtype=np.uint32)
    h[place] = _GEAR[data]
    for width in (1, 2, 4, 8, 16):
        shifted = np.zeros_like(h)
        shifted[width:] = h[:-width] << np.uint32(width)
        h = h + shifted
    return h[place]


def boundaries(data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """For each text the ends of its chunks, as offsets in data."""
    h = gear_hashes(data, at)
    open_end = IS_SPACE[data].copy()
    open_end[:-1] &= ~IS_SPACE[data[1:]]
    lead = (data & 0xC0) != 0x80
    inner = h >> np.uint32(32 - UNSPACED_BITS) == 0
    inner[:-1] &= lead[1:]
    if inner.any():  # only far from the white space, or the start of the text, before
        last = np.zeros(len(data), dtype=np.int64)
        last[IS_SPACE[data]] = np.flatnonzero(IS_SPACE[data])
        heads = at[:-1][at[:-1] < at[1:]]
        last[heads] = np.maximum(last[heads], heads)
        inner &= np.arange(len(data)) - np.maximum.accumulate(last) >= UNSPACED
    places = np.flatnonzero((open_end & (h >> np.uint32(32 - TOP_BITS) == 0)) | inner) + 1
    out, bounds = [], np.searchsorted(places, at, side="right")
    for k in range(len(at) - 1):
        a, e = int(at[k]), int(at[k + 1])
        ends, last = [], a
        for p in [*places[bounds[k] : bounds[k + 1]].tolist(), e]:
            while p - last > MOST:
                cut = last + MOST
                while not lead[cut] and cut > last + 1:
                    cut -= 1
                ends.append(cut)
                last = cut
            if p - last >= LEAST and p < e:
                ends.append(p)
                last = p
        if e > last:
            ends.append(e)
        out.append(np.array(ends, dtype=np.int64))
    return out


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Runs of texts: number of the first, their bytes, their offsets, the ends of the chunks of each."""
    data, at = raw(batch.column("text"))
    for i, j in slices(at):
        part, own = np.ascontiguousarray(data[at[i] : at[j]]), at[i : j + 1] - at[i]
        yield i, part, own, boundaries(part, own)


def _chunk_digests(data: np.ndarray, at: np.ndarray, ends: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the chunks of all texts, and the number of chunks of each."""
    sizes = np.array([len(e) for e in ends])
    last = np.concatenate(ends)
    first = np.concatenate([np.zeros(min(1, len(last)), dtype=np.int64), last[:-1]])
    first[(np.cumsum(sizes) - sizes)[sizes > 0]] = at[:-1][sizes > 0]
    return span_hashes(data, first, last).view(np.int64), sizes


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column("id")
        for i, data, at, ends in _slices(b):
            digest, sizes = _chunk_digests(data, at, ends)
            if not len(digest):
                continue
            docs = ids.slice(i, len(ends)).take(pa.array(np.repeat(np.arange(len(ends)), sizes)))
            out = pa.RecordBatch.from_arrays([docs, pa.array(digest)], names=["id", "digest"])
            yield out.filter(docs.is_valid()) if docs.null_count else out


def _words(text: bytes) -> int:
    return sum(1 if len(w) <= WORD else len(w) // PART for w in text.split())


def _removed(text: bytes, ends: list[int], foreign: set[int], least_words: int) -> tuple[list[tuple[int, int]], int]:
    """Spans of runs of foreign chunks with enough words, and the number of their chunks."""
    spans, chunks, k = [], 0, 0
    while k < len(ends):
        if k not in foreign:
            k += 1
            continue
        first = k
        while k < len(ends) and k in foreign:
            k += 1
        a, e = (ends[first - 1] if first else 0), ends[k - 1]
        if _words(text[a:e]) >= least_words:
            spans.append((a, e))
            chunks += k - first
    return spans, chunks


def _cut(least_words: int):
    schema = pa.schema([("kept_text", pa.string()), ("n_chunks", pa.int64()), ("removed_chunks", pa.int64()), ("n_bytes", pa.int64()), ("removed_bytes", pa.int64()), ("removed_spans", pa.list_(pa.list_(pa.int64())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rest = [c for c in b.schema.names if c not in ("text", "foreign")]
            for i, data, at, chunks in _slices(b):
                part = b.slice(i, len(chunks))
                foreign, null = part.column("foreign").to_pylist(), part.column("text").is_null().to_pylist()
                rows = []
                digest, sizes = _chunk_digests(data, at, chunks) if any(foreign) else (None, np.zeros(len(chunks), dtype=np.int64))
                upto = np.cumsum(sizes) - sizes
                for k, own in enumerate(chunks):
                    text, ends = data[at[k] : at[k + 1]].tobytes(), (own - at[k]).tolist()
                    spans, removed = [], 0
                    if foreign[k]:
                        of_others = np.flatnonzero(np.isin(digest[upto[k] : upto[k] + sizes[k]], foreign[k]))
                        spans, removed = _removed(text, ends, {*of_others.tolist()}, least_words)
                    kept, last = [], 0
                    for x, y in spans:
                        kept.append(text[last:x])
                        last = y
                    kept.append(text[last:])
                    rows.append((None if null[k] else b"".join(kept).decode("utf-8", "replace"), len(ends), removed, len(text), sum(y - x for x, y in spans), [[*s] for s in spans]))
                new = [pa.array([r[c] for r in rows], f.type) for c, f in enumerate(schema)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), *new], names=[*rest, *schema.names])

    return run


OUT = "kept_text string, n_chunks long, removed_chunks long, n_bytes long, removed_bytes long, removed_spans array<array<long>>"
NEW = ("kept_text", "n_chunks", "removed_chunks", "n_bytes", "removed_bytes", "removed_spans")


def _foreign(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, foreign): for each document the digests of its chunks that a document with a smaller id owns."""
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    chunks = base.mapInArrow(_digests, "id long, digest long")
    owners = chunks.groupBy("digest").agg(F.min("id").alias("owner"), F.max("id").alias("last"), F.count(F.lit(1)).alias("copies")).where("owner < last")
    owners = written(owners.select("digest", "owner", "copies"), "chunk-owners")
    found = joined(chunks, owners, ["digest"], F.xxhash64("id")).where("id != owner")
    return found.groupBy("id").agg(F.collect_set("digest").alias("foreign"))


def _cut_rows(docs: DataFrame, id_col: str, text_col: str, least_words: int) -> DataFrame:
    """The columns of docs, renamed to c0, c1 and so on, and the new ones."""
    named = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)], F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = named.join(_foreign(docs, id_col, text_col), "id", "left").drop("id")
    schema = ", ".join(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(docs.schema.fields))
    return rows.mapInArrow(_cut(least_words), f"{schema}, {OUT}")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """Each row of docs with kept_text, n_chunks, removed_chunks, n_bytes, removed_bytes, removed_spans added.

    kept_text is the text without the passages that a document with a smaller id holds too; spans are in bytes of
    UTF-8. Passages: runs of chunks, of least_words words or more, that some other document owns; very long words count as
    several. Repeats within a document stay. Null text stays null and has no chunks; rows with a null id own nothing and
    lose nothing; rows that repeat an id are one document: no row of it loses what only they hold. An empty table gives an
    empty result; other columns pass through, but for those named like the new ones, which are replaced."""
    keep = [(k, c) for k, c in enumerate(docs.columns) if c not in NEW]
    return _cut_rows(docs, id_col, text_col, least_words).select(*[F.col(f"c{k}").alias(c) for k, c in keep], *NEW)


def drop_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with its columns, texts without the passages of other documents; n_chars, where it is there, follows. Any
    other column stays as it is, whatever its name."""
    new = {text_col: F.col("kept_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("kept_text").cast(docs.schema["n_chars"].dataType)
    return _cut_rows(docs, id_col, text_col, LEAST_WORDS).select(*[(new[c] if c in new else F.col(f"c{k}")).alias(c) for k, c in enumerate(docs.columns)])

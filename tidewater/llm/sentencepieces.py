"""SentencePiece encoding and decoding for merge-type vocabularies.

A word is a list of characters; an agenda holds its adjacent pairs that make a piece, best score first, leftmost
of equals first. The best pair merges and its new neighbours enter the agenda until it is empty; what is no piece
falls back to bytes. A text is cut into words wherever no piece has the two neighbouring bytes, as nothing merges
across: Arrow finds the distinct words of a slice of texts, and what the agenda gives for them is taken for each
occurrence. A worker keeps what it found for some words, bounded in bytes. The ids of every newly met word are held
against the sentencepiece library, slice by slice."""

from __future__ import annotations

import functools
import hashlib
import operator
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.textarrays import flat, raw, slices, spans, valid

#: Fixed value: the mark that stands for a space.
MARK = "▁"
#: Merges with nothing: stands before a word that the library shall not see after a space.
BEFORE = "\n"
#: Bytes of text whose distinct words are encoded together; a longer single text is taken whole.
SLICE_BYTES = 1 << 22
#: Bytes that remembered words may take in a worker; the half met longest ago goes when they are reached.
REMEMBERED = 96 << 20


class Vocabulary:
    """Pieces, scores and byte ids of a merge-type model file."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(size)]
        plain = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)) for i in range(size)]
        self.ids = {p: i for i, p in enumerate(pieces) if plain[i]}
        self.rank = {p: -sp.get_score(i) for p, i in self.ids.items()}
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(pieces) if sp.is_byte(i)}
        if len(self.byte) != 256 or any(BEFORE in p and p != BEFORE for p in self.ids):
            raise ValueError("a vocabulary with byte fallback and without line ends in its pieces is needed")
        self.inside = np.zeros((256, 256), dtype=bool)  # the neighbouring bytes of all pieces
        for p in self.ids:
            b = np.frombuffer(p.replace(MARK, " ").encode(), dtype=np.uint8)
            self.inside[b[:-1], b[1:]] = True
        self.bytes_of = [p.replace(MARK, " ").encode() if plain[i] else b"" for i, p in enumerate(pieces)]
        for b, i in self.byte.items():
            self.bytes_of[i] = bytes([b])
        self.bytes_of[sp.unk_id()] = " ⁇ ".encode()
        self.decimal = [b",%d" % i for i in range(size)]
        self.known: dict[bytes, tuple] = {}
        self.older: dict[bytes, tuple] = {}
        self.size = 0

    def agenda(self, word: str) -> list[int]:
        """The ids of one word with its space marks."""
        rank, text, n = self.rank, list(word), len(word)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        todo = [(rank[p], k, p) for k, p in enumerate(map(operator.add, text, text[1:])) if p in rank]
        heapify(todo)
        while todo:
            _, k, piece = heappop(todo)
            left, right = text[k], after[k]
            if not left or right == n or left + text[right] != piece:
                continue  # one of the pair has merged since
            text[k], text[right] = piece, ""
            after[k] = far = after[right]
            if far < n:
                before[far] = k
                if (p := piece + text[far]) in rank:
                    heappush(todo, (rank[p], k, p))
            if (near := before[k]) >= 0 and (p := text[near] + piece) in rank:
                heappush(todo, (rank[p], near, p))
        out = []
        for t in text:
            if t:
                if (i := self.ids.get(t)) is not None:
                    out.append(i)
                else:
                    out += [self.byte[b] for b in t.encode()]
        return out

    def learn(self, words: list[bytes]) -> list[tuple[bytes, bytes, bytes]]:
        """For each word, with spaces for marks: its ids as 32-bit integers, these in decimal with a comma before each,
        and the bytes that they decode to. Words that are new are encoded and held against the library."""
        found = list(map(self.known.get, words))
        new = [k for k, x in enumerate(found) if x is None]
        if not new:
            return found
        fresh = []
        for k in new:
            if (x := self.older.get(words[k])) is None:
                fresh.append(k)
            else:
                self._keep(words[k], x)
                found[k] = x
        texts = [words[k].decode().replace(" ", MARK) for k in fresh]
        own = [self.agenda(t) for t in texts]
        # the library puts a mark before what it encodes, and gives nothing for an empty text
        seen = [t[1:] if t[0] == MARK else BEFORE + t for t in texts]
        for t, ids, want in zip(texts, own, self.library.encode(seen, num_threads=1)):
            if ids != want[2 * (t[0] != MARK) :] and t != MARK:
                raise AssertionError(f"the agenda and the library differ on {t!r}")
        for k, ids in zip(fresh, own):
            decimal, back = b"".join(map(self.decimal.__getitem__, ids)), b"".join(map(self.bytes_of.__getitem__, ids))
            found[k] = (np.array(ids, dtype="<i4").tobytes(), decimal, back)
            self._keep(words[k], found[k])
        return found

    def _keep(self, word: bytes, x: tuple) -> None:
        self.size += 300 + len(word) + sum(map(len, x))
        self.known[word] = x
        if self.size > REMEMBERED // 2:
            self.older, self.known, self.size = self.known, {}, 0

    def coded(self, texts: pa.Array) -> Iterator[tuple[list[tuple], np.ndarray, np.ndarray]]:
        """For runs of texts: what learn() gives for their distinct words, which of these each word is, and how many words
        stand before each text (and at the end). A mark in a text counts as a space, as in the library."""
        data, at = raw(texts)
        for i, j in slices(at, SLICE_BYTES):
            words, upto = split(*_spaced(*valid(data[at[i] : at[j]], at[i : j + 1] - at[i])), self.inside)
            coded = words.dictionary_encode()
            yield self.learn(coded.dictionary.to_pylist()), coded.indices.to_numpy(zero_copy_only=False), upto

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, without begin or end; null as empty."""
        for found, which, upto in self.coded(texts):
            for part in _parts(found, 0, which, upto):
                yield part.view("<i4")

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the space that encoding put before it goes."""
        return _text(np.frombuffer(b"".join(map(self.bytes_of.__getitem__, ids)), dtype=np.uint8)).decode()


def _text(data: np.ndarray) -> bytes:
    """The text of decoded bytes: the space that encoding put before it goes, what is no UTF-8 is replaced."""
    data = valid(data, np.array([0, len(data)]))[0].tobytes()
    return data.removeprefix(b" ")


def _spaced(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a space instead of each mark."""
    mark = MARK.encode()
    if mark not in (whole := data.tobytes()):
        return data, at
    texts = [whole[a:e].replace(mark, b" ") for a, e in zip(at[:-1].tolist(), at[1:].tolist())]
    return np.frombuffer(b"".join(texts), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])


def split(data: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, and how many stand before each text (and at the end). A text that isn't empty has one
    space more before it; a word starts with each character that no piece has after the byte before it."""
    some, sizes = at[:-1] < at[1:], np.diff(at)
    more = np.cumsum(some)
    out = np.full(len(data) + int(some.sum()), 32, dtype=np.uint8)
    out[np.arange(len(data)) + np.repeat(more, sizes)] = data
    at = at + np.concatenate([[0], more])
    first = (out & 0xC0) != 0x80
    first[1:] &= ~inside[out[:-1], out[1:]]
    first[at[:-1][some]] = True
    starts = np.flatnonzero(first)
    return spans(out, np.append(starts, len(out))), np.searchsorted(starts, at)


def _parts(found: list[tuple], k: int, which: np.ndarray, upto: np.ndarray) -> Iterator[np.ndarray]:
    """Column k of what was found for words, end to end for each text, as bytes."""
    column = [x[k] for x in found]
    sizes = np.fromiter(map(len, column), dtype=np.int64, count=len(column))
    each = spans(np.frombuffer(b"".join(column), dtype=np.uint8), np.concatenate([[0], np.cumsum(sizes)]))
    data, at = flat(each.take(pa.array(which)))
    at = at[upto].tolist()
    for a, b in zip(at[:-1], at[1:]):
        yield data[a:b]


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids for each row of docs: what the library gives for the whole text without begin or end; null text
    counts as empty. Null ids and repeated rows stay; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = pa.array([x.tolist() for x in vocabulary(model).encode(b.column("text"))], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("id"), ids], names=["id", "ids"])

    rows = _base(docs, id_col, text_col)
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>").withColumnRenamed("id", id_col)


def decode(rows: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, text for each row of ids; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([vocabulary(model).decode(x or []) for x in b.column("ids").to_pylist()], pa.string())], names=["id", "text"])

    some = rows.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return some.mapInArrow(run, f"id {some.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 for each row of docs: the encoded ids, in decimal with commas, and
    the text decoded from them. Nulls and repeats as encode() has them; an empty table gives an empty result."""
    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for b in batches:
            n, of_ids, of_text = [], [], []
            for found, which, upto in v.coded(b.column("text")):
                n += [len(x) // 4 for x in _parts(found, 0, which, upto)]
                of_ids += [hashlib.sha256(x[1:]).hexdigest() for x in _parts(found, 1, which, upto)]
                of_text += [hashlib.sha256(_text(x)).hexdigest() for x in _parts(found, 2, which, upto)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=names)

    rows = _base(docs, id_col, text_col)
    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)

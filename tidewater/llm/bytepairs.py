"""Byte-level BPE vocabularies: splitting texts into pre-tokens and merging them.

split() finds the pre-tokens of many texts at once: code points are mapped to classes, and the alternatives of
the vocabulary's pattern become comparisons of neighbouring classes. The distinct pre-tokens of a slice of texts
are found by Arrow, RankMerger merges them as one ragged array, and their results are taken for each occurrence.
Nothing is remembered from slice to slice, so a worker's memory is bounded by a slice."""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tidewater.llm.textarrays import flat, raw, slices, spans, valid

#: Classes of code points in the split pattern ('s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+).
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: What may follow an apostrophe as one pre-token with it.
SHORT = ("s", "t", "re", "ve", "m", "ll", "d")
#: Bytes of text whose distinct pre-tokens are merged together; a longer single text is taken whole.
SLICE_BYTES = 1 << 19
#: Bytes from which a pre-token is merged by itself, rank after rank.
LONG = 128
#: The rank of a pair that doesn't merge.
NONE = np.int32(2**31 - 1)


@functools.cache
def classes() -> np.ndarray:
    """The class of each code point, as the tokenizers library's own pattern engine sees it."""
    from tokenizers import Regex, normalizers

    table = np.zeros(0x110000, dtype=np.uint8)
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        replace = normalizers.Replace(Regex(pattern), "\0")
        for k in range(0, len(points), 65536):
            some = points[k : k + 65536]
            seen = np.frombuffer(replace.normalize_str("".join(map(chr, some))).encode("utf-32-le"), dtype=np.uint32)
            table[np.asarray(some)[seen == 0]] = kind
    return table


def split(cp: np.ndarray, at: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where pre-tokens start in the code points cp of texts that start at at[:-1]."""
    n = len(cp)
    if not n:
        return np.zeros(0, dtype=np.int64)
    kind = kinds[cp]
    head = np.zeros(n + 1, dtype=bool)
    head[at] = True
    begins = head[:n].copy()
    begins[1:] |= kind[1:] != kind[:-1]
    blank = kind == SPACE
    # one plain space before anything but white space belongs to it
    joined = np.zeros(n, dtype=bool)
    joined[1:] = (cp[:-1] == 32) & ~blank[1:]
    joined &= ~head[:n]
    begins &= ~joined
    # of white space before something else, the last character stands apart
    last = blank.copy()
    last[:-1] &= ~blank[1:] & ~head[1:n]
    last[-1] = False
    begins |= last
    # contractions
    mark = np.flatnonzero((cp == 39) & begins)
    if len(mark):
        end = np.searchsorted(at, mark, side="right")
        left = at[end] - mark
        pad = np.concatenate([cp, np.zeros(3, dtype=cp.dtype)])
        for s in SHORT:
            hit = left > len(s)
            for k, c in enumerate(s):
                hit &= pad[mark + 1 + k] == ord(c)
            own = mark[hit]
            begins[own + 1] = False
            after = own + 1 + len(s)
            begins[after[after < n]] = True
    return np.flatnonzero(begins)


def _code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Code points of UTF-8 bytes, and the byte where each starts (None where that is its number)."""
    if not (data & 0x80).any():
        return data, None
    cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    return cp, np.flatnonzero((data & 0xC0) != 0x80)


def pretokens(texts: pa.Array, kinds: np.ndarray, special: tuple[str, ...]) -> Iterator[tuple[pa.Array, np.ndarray, bool]]:
    """For runs of texts: all pre-tokens in order, how many stand before each text (and at the end), and whether
    special strings are among them. A special string is a pre-token of its own, as the library treats it by default."""
    data, at = raw(texts)
    for i, j in slices(at, SLICE_BYTES):
        part, own = valid(data[at[i] : at[j]], at[i : j + 1] - at[i])
        cp, byte_at = _code_points(part)
        text, bounds = part.tobytes(), own if byte_at is None else np.searchsorted(byte_at, own)
        cuts, inner = bounds, []
        for s in map(str.encode, special):
            p = text.find(s)
            while p >= 0:
                e = p + len(s)
                if np.searchsorted(own, p, side="right") == np.searchsorted(own, e - 1, side="right"):
                    inner.append((p, e) if byte_at is None else tuple(np.searchsorted(byte_at, (p, e)).tolist()))
                p = text.find(s, e)
        if inner:
            cuts = np.unique(np.concatenate([bounds, np.asarray(inner).ravel()]))
        starts = split(cp, cuts, kinds)
        if inner:
            inside = np.zeros(len(cp) + 1, dtype=bool)
            for p, e in inner:
                inside[p + 1 : e] = True
            starts = starts[~inside[starts]]
        yield spans(part, np.append(starts if byte_at is None else byte_at[starts], len(part))), np.searchsorted(starts, bounds), bool(inner)


@functools.cache
def specials(path: str) -> dict[str, int]:
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"] if t["special"]}


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file: printable bytes stand for
    themselves, the others for the code points from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class PairRanks:
    """The rank of a pair of symbols, for whole arrays: a table with open addressing."""

    def __init__(self, pairs: list[tuple[int, int]], width: int):
        self.width = width
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.ranks = np.full(1 << self.bits, NONE, dtype=np.int32)
        todo = np.arange(len(pairs))
        keys = np.array([a * width + b for a, b in pairs], dtype=np.int64)
        slot = self._slots(keys)
        while len(todo):
            free = self.keys[slot] == -1
            _, one = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            put = one[free[one]]  # of those that want a free place, one gets it
            self.keys[slot[put]], self.ranks[slot[put]] = keys[todo[put]], todo[put]
            left = np.ones(len(todo), dtype=bool)
            left[put] = False
            todo, slot = todo[left], (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) * self.width + right
        slot = self._slots(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.ranks[slot], NONE)
        todo = np.flatnonzero((held != keys) & (held != -1))
        slot, keys = slot[todo], keys[todo]
        while len(todo):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot]
            out[todo] = np.where(held == keys, self.ranks[slot], NONE)
            on = (held != keys) & (held != -1)
            todo, slot, keys = todo[on], slot[on], keys[on]
        return out


class RankMerger:
    """The symbols that are left of each pre-token after all merges, for whole batches.

    The symbols of all sequences lie in one array. In each round every sequence finds its adjacent pair of the
    lowest rank and merges all places of that pair, from the left where they overlap; all sequences advance in
    the same round, and those without a pair that merges leave. As each merge makes a new symbol of a higher
    rank than what it is made of, this gives what one merge at a time gives. Ranks are looked up again only
    beside a merge. A sequence of LONG bytes or more is merged by itself, so that its cost follows its length and
    not its length times its rounds."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.of_byte = np.array([vocab[c] for c in byte_symbols()], dtype=np.int32)
        self.pairs = [(vocab[a], vocab[b]) for a, b in merges]
        self.rank = PairRanks(self.pairs, max(vocab.values()) + 1)
        self.made = np.array([vocab[a + b] for a, b in merges], dtype=np.int32)

    @functools.cached_property
    def _by_pair(self) -> dict[tuple[int, int], int]:
        return {p: k for k, p in enumerate(self.pairs)}

    def _rounds(self, ids: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(numbers, symbols left of each, all these symbols) of the sequences that end in a round."""
        own, ends = np.arange(len(sizes)), np.cumsum(sizes)
        rank = np.full(len(ids), NONE, dtype=np.int32)
        if len(ids):
            rank[:-1] = self.rank(ids[:-1], ids[1:])
            rank[ends - 1] = NONE
        while len(own):
            least = np.minimum.reduceat(rank, ends - sizes)
            going = least < NONE
            if not going.all():
                on = np.repeat(going, sizes)
                yield own[~going], sizes[~going], ids[~on]
                ids, rank, own, sizes, least = ids[on], rank[on], own[going], sizes[going], least[going]
                if not len(own):
                    return
                ends = np.cumsum(sizes)
            at = np.flatnonzero(rank == np.repeat(least, sizes))
            fresh = np.ones(len(at), dtype=bool)
            fresh[1:] = at[1:] != at[:-1] + 1
            if not fresh.all():  # of overlapping places every second one counts
                lead = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - lead) % 2 == 0]
            sizes = sizes - np.bincount(np.searchsorted(ends, at, side="right"), minlength=len(sizes))
            ids[at] = self.made[rank[at]]
            stay, beside = np.ones(len(ids), dtype=bool), np.zeros(len(ids) + 1, dtype=bool)
            stay[at + 1] = False
            beside[at] = beside[at - 1] = True  # a place before the first is the spare one at the end
            ids, rank, beside = ids[stay], rank[stay], np.flatnonzero(beside[:-1][stay])
            ends = np.cumsum(sizes)
            rank[beside] = self.rank(ids[beside], ids[np.minimum(beside + 1, len(ids) - 1)])
            rank[ends - 1] = NONE

    def _alone(self, ids: list[int]) -> list[int]:
        """One long sequence: the places of each rank wait together, the ranks in a heap; all places of the lowest
        merge from the left, and new pairs, whose ranks are higher, join the places of theirs."""
        ranks, n = self._by_pair, len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        places: dict[int, list[int]] = {}
        for k in range(n - 1):
            if (r := ranks.get((ids[k], ids[k + 1]))) is not None:
                places.setdefault(r, []).append(k)
        heap = [*places]
        heapq.heapify(heap)
        while heap:
            r = heapq.heappop(heap)
            (a, b), new = self.pairs[r], int(self.made[r])
            for k in sorted(places.pop(r)):
                right = after[k]
                if ids[k] != a or right >= n or ids[right] != b:
                    continue  # one of the pair has merged since
                ids[k], ids[right] = new, -1
                after[k] = far = after[right]
                if far < n:
                    before[far] = k
                for x, y in ((before[k], k), (k, far)):
                    if 0 <= x and y < n and (s := ranks.get((ids[x], ids[y]))) is not None:
                        if s not in places:
                            places[s] = []
                            heapq.heappush(heap, s)
                        places[s].append(x)
        return [x for x in ids if x >= 0]

    def merged(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the sequences that start at at[:-1] in data: all symbols left, and how many of each."""
        ids, sizes = self.of_byte[data], np.diff(at)
        parts, owns, lefts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        short = sizes < LONG
        numbers = np.flatnonzero(short & (sizes > 0))
        for own, left, symbols in self._rounds(ids[np.repeat(short, sizes)], sizes[numbers]):
            parts.append(symbols)
            owns.append(numbers[own])
            lefts.append(left)
        for k in np.flatnonzero(~short).tolist():
            parts.append(np.array(self._alone(ids[at[k] : at[k + 1]].tolist()), dtype=np.int32))
            owns.append(np.array([k]))
            lefts.append(np.array([len(parts[-1])]))
        own, left, symbols = (np.concatenate(x) for x in (owns, lefts, parts))
        order = np.argsort(own, kind="stable")
        first = (np.cumsum(left) - left)[order]
        out = np.zeros(len(sizes), dtype=np.int64)
        out[own] = left
        return symbols[np.repeat(first - (np.cumsum(left[order]) - left[order]), left[order]) + np.arange(len(symbols))], out


@functools.cache
def merger(path: str) -> RankMerger:
    return RankMerger(path)


def _slices(texts: pa.Array, path: str, kinds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of texts: ids of their distinct pre-tokens, how many of each, which each pre-token is, and how many
    pre-tokens stand before each text (and at the end)."""
    special = specials(path)
    for tokens, upto, marked in pretokens(texts, kinds, tuple(special)):
        coded = tokens.dictionary_encode()
        data, at = flat(coded.dictionary)
        ids, sizes = merger(path).merged(data, at)
        if marked:
            known = coded.dictionary.to_pylist()
            for s, i in special.items():
                if s.encode() in known:
                    k = known.index(s.encode())
                    first = int(sizes[:k].sum())
                    ids = np.concatenate([ids[:first], np.array([i], dtype=np.int32), ids[first + sizes[k] :]])
                    sizes[k] = 1
        yield ids, sizes, coded.indices.to_numpy(zero_copy_only=False), upto


def token_counts(texts: pa.Array, path: str, kinds: np.ndarray) -> np.ndarray:
    """The number of tokens of each text."""
    out = [np.zeros(0, dtype=np.int64)]
    for _, sizes, which, upto in _slices(texts, path, kinds):
        out.append(np.diff(np.concatenate([[0], np.cumsum(sizes[which])])[upto]))
    return np.concatenate(out)


def token_ids(texts: pa.Array, path: str, kinds: np.ndarray) -> Iterator[np.ndarray]:
    """The ids that the tokenizers library gives for each text, as unsigned 32-bit integers."""
    for ids, sizes, which, upto in _slices(texts, path, kinds):
        each = spans(ids.view(np.uint8), np.concatenate([[0], np.cumsum(sizes)]) * 4)
        all_ids = flat(each.take(pa.array(which)))[0].view("<u4")
        at = np.concatenate([[0], np.cumsum(sizes[which])])[upto].tolist()
        for a, b in zip(at[:-1], at[1:]):
            yield all_ids[a:b]

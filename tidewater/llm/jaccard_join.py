"""Exact Jaccard join of documents' word shingles, with set-relation skipping.

Sets that are equal are joined as one. Shingles have one order: rare before frequent, where frequency is known
for a bounded list of the heaviest and all others count as rare. Two sets that reach the threshold share a
shingle in their prefixes in this order, so sets that hold a shingle in their prefix, and are of sizes that can link, are
a list. Short lists give pairs, of which only those go on whose places in the order and shared shingles leave room for
the overlap that a link needs; a long list is cut by size first, and what stays long meets at its least set, its lead. A
lead's members come together once, however many lists they share, and a pair of short lists whose sets have the same least lead only there.

Among the sets of a block, in order of size, a set reads of its index lists only the positions of sets that its size allows:
the others are skipped. Its overlaps are derived from those of a highly similar set where there is one: only the lists of
shingles that one has and the other lacks are read. What leaves a block is a spanning forest of its links.

A lead with more members than a block is first held against each of them (in chunks, each with the lead). Those
that link to it are one component, so no pair of them is looked at again. By the triangle inequality of the Jaccard
distance, others can link to one of these only if their distance from the lead is at most twice the limit; they meet
these in blocks. The others among themselves are a group with a lead of its own, and so on while each round takes
half of a group; only a group whose lead has few links is cut into blocks of which each pair is a task. So what a group of
near copies moves follows its size."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.links import components
from tidewater.llm.spread import joined, with_listed, without
from tidewater.llm.textarrays import raw, shingle_sets, slices, small_batches
from tidewater.storage import settled, written

#: Heaviest shingles that are ordered by count: 16 bytes each, 8 MB in a broadcast.
HEAVY = 524_288
#: A shingle is reported as heavy by a task that counted so many sets with it.
HEAVY_IN_TASK = 2
#: Shingles that are counted at once, and counts that a task carries on.
RUN, CARRIED = 500_000, 500_000
#: Digests of sets that a task remembers, so as not to send or count a set again.
SEEN = 500_000
#: A list of more than one in HOT of all sets, and of more than HOT sets, is spread over several tasks.
HOT = 1000
#: Sets that come together in one task; a pair of blocks has twice as many.
BLOCK = 512
#: Sets of a part of a list of which all pairs are counted.
PART = 32


def _sets(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int, np.ndarray]]:
    data, at = raw(batch.column("text"))
    for i, j in slices(at):
        yield from enumerate(shingle_sets(data[at[i] : at[j]], at[i : j + 1] - at[i], n), i)


def _digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _key(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


class _Heavy:
    """Counts of the heaviest shingles of a task, by Misra and Gries: when there are more than CARRIED, all lose what the
    first beyond them has. A count is at most the true one, and less by at most the shingles seen divided by CARRIED."""

    def __init__(self):
        self.tokens, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, s: np.ndarray) -> None:
        self.held.append(s)
        self.size += len(s)
        if self.size >= RUN:
            self.squeeze()

    def squeeze(self) -> None:
        tokens = np.concatenate([self.tokens, *self.held])
        weights = np.ones(len(tokens), dtype=np.int64)
        weights[: len(self.counts)] = self.counts
        order = np.argsort(tokens)
        tokens = tokens[order]
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(tokens)), bool), tokens[1:] != tokens[:-1]]))
        self.tokens = tokens[first]
        self.counts = np.add.reduceat(weights[order], first) if len(first) else np.zeros(0, np.int64)
        if len(self.tokens) > CARRIED:
            self.counts = self.counts - np.partition(self.counts, len(self.counts) - CARRIED - 1)[len(self.counts) - CARRIED - 1]
            self.tokens, self.counts = self.tokens[self.counts > 0], self.counts[self.counts > 0]
        self.held, self.size = [], 0


def _signatures(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        heavy, names = _Heavy(), ["id", "digest", "n", "token", "count"]
        for b in batches:
            digests, counts = [], []
            for _, s in _sets(b, n):
                digests.append(d := _digest(s))
                counts.append(len(s))
                if len(s) and d not in seen:
                    seen.add(d)
                    heavy.add(s)
            if len(seen) > SEEN:
                seen.clear()
            k = len(digests)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(digests, pa.binary()), pa.array(counts, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())], names=names)
        heavy.squeeze()
        much = heavy.counts >= HEAVY_IN_TASK
        tokens, counts = heavy.tokens[much].view(np.int64), heavy.counts[much]
        for a in range(0, len(tokens), 200_000):
            t = pa.array(tokens[a : a + 200_000])
            k = len(t)
            yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.int64()), t, pa.array(counts[a : a + 200_000])], names=names)

    return run


def prefix(s: np.ndarray, num: int, den: int, heavy: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The shingles of the set s that a set with a similarity of num / den or more must share one of."""
    p = len(s) - (num * len(s) + den - 1) // den + 1
    if not len(heavy):
        return s[:p]
    place = np.searchsorted(heavy, s)
    place[place == len(heavy)] = 0
    known = heavy[place] == s
    rare = s[~known]
    if len(rare) >= p:
        return rare[:p]
    late = s[known][np.argsort(rank[place[known]], kind="stable")]
    return np.concatenate([rare, late[: p - len(rare)]])


def _postings(n: int, num: int, den: int, sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, rank, hottest = sent.value
        seen: set[bytes] = set()
        for b in batches:
            tokens, lengths, keys, sizes, places = [], [], [], [], []
            for _, s in _sets(b, n):
                if len(s) and (d := _digest(s)) not in seen:
                    seen.add(d)
                    tokens.append(t := prefix(s, num, den, heavy, rank))
                    lengths.append(len(t))
                    places.append(np.arange(len(t), dtype=np.int32))
                    sizes.append(len(s))
                    keys.append(_key(d))
            if len(seen) > SEEN:
                seen.clear()
            if tokens:
                each, all_ = np.array(lengths), np.concatenate(tokens)
                columns = [all_.view(np.int64), np.isin(all_, hottest), np.repeat(np.array(keys, dtype=np.int64), each), np.repeat(np.array(sizes, dtype=np.int32), each), np.concatenate(places)]
                for k in range(0, int(each.sum()), 200_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 200_000]) for c in columns], names=["token", "hot", "key", "size", "place"])

    return run


def _met(postings: DataFrame, num: int, den: int) -> DataFrame:
    """(key, lead, listed) of the sets that may link; listed: with any others of that lead, not with it alone.

    A list in order of size falls apart where the next size is too large for the threshold; no pair across such a
    place can link, and what stands alone goes. Parts of more than PART sets are cut again by _windows. In parts of up
    to PART sets the pairs themselves are counted, as _pairs says. A pair that meets in a larger part goes on
    uncounted: all sets of that part meet at its lead. Hot lists are counted by size before they are cut, so that no
    task holds one."""
    hot, postings = postings.where("hot").drop("hot", "place"), postings.where("not hot").drop("hot")
    by_size, part = Window.partitionBy("token").orderBy("size", "key"), Window.partitionBy("token", "part")
    size, before, after = F.col("size"), F.lag("size").over(by_size), F.lead("size").over(by_size)
    rows = postings.withColumns({"apart": F.coalesce(den * before < num * size, F.lit(True)), "follows": F.coalesce(den * size >= num * after, F.lit(False))})
    rows = rows.withColumn("part", F.sum(F.col("apart").cast("int")).over(by_size.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.where("not apart or follows").select("token", "part", "key", "size", "place").distinct()
    rows = written(rows.withColumns({"sets": F.count(F.lit(1)).over(part), "lead": F.min("key").over(part)}).where("sets > 1"), "shared-postings")

    short = rows.where(F.col("sets") <= PART).select("token", "part", F.lit(0).alias("window"), "key", "size", "place", F.lit(False).alias("guest"))
    cut = written(_windows(rows.where(F.col("sets") > PART), num, den), "windows")
    pairs = _pairs(short.unionByName(cut.where(F.col("sets") <= PART).drop("sets", "lead")), num, den)
    long = cut.where((F.col("sets") > PART) & (F.col("key") != F.col("lead"))).select("key", "lead").union(_met_hot(hot, num, den))
    met = long.withColumn("listed", F.lit(True)).union(pairs.withColumn("listed", F.lit(False)))
    return met.groupBy("key", "lead").agg(F.max("listed").alias("listed"))


def _once(met: DataFrame) -> DataFrame:
    """met without the pairs, not of a long list, whose sets both have the same least lead: they meet there, with all others of
    it. The row of a set and its own least lead always stays, as that lead's least one is smaller."""
    least = met.groupBy("key").agg(F.min("lead").alias("least"))
    rows = met.join(least, "key").join(least.toDF("lead", "above"), "lead", "left")
    return rows.where("listed or above is null or above != least").select("key", "lead")


def _windows(rows: DataFrame, num: int, den: int) -> DataFrame:
    """The rows of parts by window of size: two sets that may link are of the same class of size or of neighbouring ones, so each
    is in the window of its class and, as a guest, in the next; guests of a window meet in the one before."""
    window = Window.partitionBy("token", "part", "window")
    own = F.floor(F.log(F.col("size").cast("double")) / F.lit(np.log(den / num) * 1.0001)) if num < den else F.col("size")
    rows = rows.withColumn("class", own.cast("int")).withColumn("window", F.explode(F.array("class", F.col("class") + 1)))
    rows = rows.select("token", "part", "window", "key", "size", "place", (F.col("window") > F.col("class")).alias("guest"))
    rows = rows.withColumns({"sets": F.count(F.lit(1)).over(window), "lead": F.min("key").over(window), "alone": F.min("guest").over(window)})
    return rows.where("sets > 1 and not alone").drop("alone")


def _pairs(lists: DataFrame, num: int, den: int) -> DataFrame:
    """(key, lead) of the pairs of short lists that may link, by their overlap's upper bounds.

    Before a shared shingle two sets share at most what the one has there that is less far into its order, and behind it
    what has fewer left: pairs whose places differ too much go at once. Of the rest the shared shingles in both
    prefixes are counted. All others that they share lie behind the last of these, in both, and behind the
    prefix that ends first."""
    few = lists.groupBy("token", "part", "window").agg(F.sort_array(F.collect_list(F.struct("key", "size", "place", "guest"))).alias("all"))
    pairs = few.select("all", F.posexplode("all").alias("k", "a")).select("a", F.explode(F.slice("all", F.col("k") + 2, F.lit(PART))).alias("b"))
    left = F.least(*[F.col(f"{x}.size") - F.col(f"{x}.place") - 1 for x in "ab"])
    needed = lambda m, size: F.ceil((F.col(m) + F.col(size)) * num / F.lit(num + den))
    pairs = pairs.where("not (a.guest and b.guest)").where(F.least("a.place", "b.place") + 1 + left >= needed("a.size", "b.size"))
    pairs = pairs.groupBy("a.key", "b.key", "a.size", "b.size").agg(F.count(F.lit(1)).alias("n"), F.min(left).alias("left")).toDF("lead", "key", "m", "size", "n", "left")
    rest = F.greatest(*[F.ceil(F.col(c) * num / F.lit(den)) - 1 for c in ("m", "size")])
    return pairs.where(F.col("n") + F.least("left", rest) >= needed("m", "size")).select("key", "lead")


def _met_hot(postings: DataFrame, num: int, den: int) -> DataFrame:
    """As _met, for lists that are too long for one task: they are cut where sizes are apart, and counted by size."""
    by_size, part = Window.partitionBy("token").orderBy("size"), Window.partitionBy("token", "part")
    sizes = postings.groupBy("token", "size").agg(F.count(F.lit(1)).alias("copies"), F.min("key").alias("least"))
    sizes = sizes.withColumn("apart", F.coalesce(den * F.lag("size").over(by_size) < num * F.col("size"), F.lit(True)).cast("int"))
    sizes = sizes.withColumn("part", F.sum("apart").over(by_size.rowsBetween(Window.unboundedPreceding, 0)))
    sizes = sizes.select("token", "size", "copies", F.sum("copies").over(part).alias("sets"), F.min("least").over(part).alias("lead"))
    sizes = written(sizes, "hot-sizes")
    rows = joined(postings, sizes, ["token", "size"], F.xxhash64("key"))
    return rows.where("sets > 1 and key != lead").select("key", "lead")


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All positions of the ranges that start at first."""
    total = int(size.sum())
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(total)


def link_sets(sets: list[np.ndarray], num: int, den: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets; with side, of those between sets of different sides."""
    g = len(sets)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    order = np.argsort(size, kind="stable")
    size = size[order]
    tokens = np.concatenate([sets[k] for k in order])
    owner = np.repeat(np.arange(g), size)
    _, code, count = np.unique(tokens, return_inverse=True, return_counts=True)
    shared = count[code] > 1  # the others add to no overlap
    code, owner = code[shared], owner[shared]
    by_code = np.argsort(code, kind="stable")
    lists = owner[by_code]
    places = code[by_code] * g + lists  # in order: any run of positions of a list is found by two searches
    rows_at = np.searchsorted(owner, np.arange(g + 1))
    sorted_codes = [np.sort(code[rows_at[x] : rows_at[x + 1]]) for x in range(g)]
    low = np.searchsorted(size, (num * size + den - 1) // den)  # the first set large enough for each

    def counted(codes: np.ndarray, first: int, end: int) -> np.ndarray:
        """How many of the lists hold each position from first to end; positions outside are skipped."""
        if first >= end or not len(codes):
            return np.zeros(max(end - first, 0), dtype=np.int64)
        a, e = np.searchsorted(places, codes * g + first), np.searchsorted(places, codes * g + end)
        return np.bincount(lists[_ranges(a, e - a)] - first, minlength=end - first)

    label, forest = np.arange(g), []
    overlaps: list[np.ndarray] = []  # of x with the positions from low[x] to x
    by_least: dict[int, int] = {}
    ok_side = np.ones(g, dtype=bool) if side is None else side[order]
    for x in range(g):
        own, lo = sorted_codes[x], int(low[x])
        # the set before, and the last with the same least shingle, are likely to be similar
        like, new, gone = None, own, own
        for p in {x - 1, by_least.get(int(own[0]), -1) if len(own) else -1}:
            if p >= lo:
                more, less = np.setdiff1d(own, sorted_codes[p], assume_unique=True), np.setdiff1d(sorted_codes[p], own, assume_unique=True)
                if len(more) + len(less) < (len(new) + len(gone) if like is not None else len(own)):
                    like, new, gone = p, more, less
        if like is not None:
            overlap = np.concatenate([
                overlaps[like][lo - int(low[like]) :] + counted(new, lo, like) - counted(gone, lo, like),
                [len(own) - len(new)], counted(own, like + 1, x),
            ])
        else:
            overlap = counted(own, lo, x)
        overlaps.append(overlap)
        if len(own):
            by_least[int(own[0])] = x
        if lo < x:
            hit = (num + den) * overlap >= num * (size[x] + size[lo:x])
            if side is not None:
                hit &= ok_side[lo:x] != ok_side[x]
            hit = np.flatnonzero(hit) + lo
            for y in hit[np.unique(label[hit], return_index=True)[1]]:
                if label[y] != label[x]:
                    forest.append((int(order[x]), int(order[y])))
                    label[label == label[y]] = label[x]
    return forest


EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _forest(own: list[tuple[int, int, np.ndarray]], num: int, den: int, sides: bool) -> list[tuple[int, int]]:
    """Links of (id, side, set), each id and side once."""
    best: dict[tuple[int, int], tuple] = {}
    for r in own:
        best.setdefault(r[:2], r)
    own = [*best.values()]
    if len(own) < 2:
        return []
    side = np.array([r[1] for r in own]) if sides else None
    return [(own[a][0], own[b][0]) for a, b in link_sets([r[2] for r in own], num, den, side)]


def _edges(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"a": [x[0] for x in links], "b": [x[1] for x in links]}, schema=EDGES)


def _of_texts(n: int, num: int, den: int):
    """Links within groups of texts, one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for b in batches:
            leads, ids, want, out = b.column("lead").to_pylist(), b.column("id").to_pylist(), b.column("key").to_pylist(), []
            for k, s in _sets(b, n):
                if leads[k] != now:
                    out += _forest(rows, num, den, False)
                    now, rows = leads[k], []
                if _key(_digest(s)) == want[k]:  # a repeated id may bring another text
                    rows.append((ids[k], 0, s))
            yield _edges(out)
        yield _edges(_forest(rows, num, den, False))

    return run


def _large_sets(n: int):
    """(key, id, set) of texts whose set has the key that is wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, want = b.column("id").to_pylist(), b.column("key").to_pylist()
            rows = [(want[k], ids[k], s.tobytes()) for k, s in _sets(b, n) if len(s) and _key(_digest(s)) == want[k]]
            columns = [*zip(*rows)] or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], names=["key", "id", "set"])

    return run


def _by_group(names: list[str], done):
    """Runs of rows with equal names, handed to done with their ids, sides, keys and sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for b in batches:
            keys = [*zip(*(b.column(c).to_pylist() for c in names))]
            for group, key, i, side, s in zip(keys, *(b.column(c).to_pylist() for c in ("key", "id", "side", "set"))):
                if group != now:
                    if rows:
                        yield done(now, rows)
                    now, rows = group, []
                rows.append((i, side, np.frombuffer(s, dtype=np.uint64), key))
        if rows:
            yield done(now, rows)

    return run


STARS = pa.schema([("lead", pa.int64()), ("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("kind", pa.int32())])


def _stars(num: int, den: int):
    """Holds the lead of a chunk against its members: kind 0 links to it, 1 may link to such a one, 2 can't."""

    def done(group: tuple, rows: list) -> pa.RecordBatch:
        lead = next(r for r in rows if r[3] == group[0])
        rows = [r for r in rows if r[3] != group[0]]
        if not rows:
            return pa.RecordBatch.from_pylist([], schema=STARS)
        size = np.array([len(r[2]) for r in rows])
        tokens = np.concatenate([r[2] for r in rows])
        place = np.minimum(np.searchsorted(lead[2], tokens), len(lead[2]) - 1)
        overlap = np.add.reduceat((lead[2][place] == tokens).astype(np.int64), np.cumsum(size) - size)
        both, twice = size + len(lead[2]), 2 * num - den
        kind = np.where((num + den) * overlap >= num * both, 0, np.where((twice + den) * overlap >= twice * both, 1, 2))
        k = len(rows)
        return pa.RecordBatch.from_arrays([pa.array([group[0]] * k, pa.int64()), pa.array([r[3] for r in rows], pa.int64()), pa.array([lead[0]] * k, pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array(kind, pa.int32())], schema=STARS)

    return _by_group(["lead", "chunk"], done)


def _pairs_of_blocks(num: int, den: int):
    def done(group: tuple, rows: list) -> pa.RecordBatch:
        return _edges(_forest([r[:3] for r in rows], num, den, group[1] != group[2]))

    return _by_group(["lead", "i", "j"], done)


def _chunk(count: str):
    """The number of a row's chunk among those that count rows make."""
    return F.pmod(F.xxhash64("key", "lead"), F.ceil(F.col(count) / F.lit(BLOCK))).cast("int")


def _each(count: str):
    return F.explode(F.sequence(F.lit(0), F.ceil(F.col(count) / F.lit(BLOCK)).cast("int") - 1))


def _large_groups(members: DataFrame, sets: DataFrame, num: int, den: int) -> list[DataFrame]:
    """Tables of links of the groups (lead, key) with more than a block of members; the lead is one of them."""
    links = []
    counted = lambda m: m.join(m.groupBy("lead").agg(F.count(F.lit(1)).alias("n")), "lead")

    def placed(rows: DataFrame, *names: str) -> DataFrame:
        rows = rows.join(sets, "key").repartition(*names).sortWithinPartitions(*names)
        return rows.select(*names, "key", "id", "side", "set")

    def blocked(rows: DataFrame) -> None:
        """rows (lead, key, side, i, j): all pairs of different sides, or of a block with itself."""
        links.append(written(placed(rows, "lead", "i", "j").mapInArrow(_pairs_of_blocks(num, den), "a long, b long"), "block-links"))

    members = written(counted(members), "large-groups")
    while not members.isEmpty():
        lead = members.where("key = lead").withColumn("chunk", _each("n"))
        rows = members.where("key != lead").withColumn("chunk", _chunk("n")).unionByName(lead).withColumn("side", F.lit(0))
        stars = placed(rows, "lead", "chunk").mapInArrow(_stars(num, den), "lead long, key long, a long, b long, kind int")
        stars = written(stars, "stars")
        links.append(stars.where("kind = 0").select("a", "b"))
        sums = {f"n{k}": F.count_if(F.col("kind") == k) for k in range(3)}
        counts = written(stars.groupBy("lead").agg(*[c.alias(k) for k, c in sums.items()]), "star-counts")
        near = stars.where("kind < 2").join(counts.where("n0 > 0 and n1 > 0"), "lead")
        star = near.where("kind = 0").select("lead", "key", F.lit(0).alias("side"), _chunk("n0").alias("i"), _each("n1").alias("j"))
        other = near.where("kind = 1").select("lead", "key", F.lit(1).alias("side"), _each("n0").alias("i"), _chunk("n1").alias("j"))
        if not counts.where("n0 > 0 and n1 > 0").isEmpty():
            blocked(star.unionByName(other).withColumn("j", -1 - F.col("j")))  # below zero: never the same as i
        rest = stars.where("kind > 0").join(counts, "lead").select("lead", "key", "n0", (F.col("n1") + F.col("n2")).alias("n"))
        stuck = rest.where((F.col("n") <= BLOCK) | (F.col("n0") < F.col("n"))).where("n > 1")
        if not stuck.isEmpty():
            own = stuck.withColumns({"side": _chunk("n"), "other": _each("n")})
            blocked(own.select("lead", "key", "side", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j")))
        rest = rest.where((F.col("n") > BLOCK) & (F.col("n0") >= F.col("n"))).drop("n0")
        least = rest.groupBy("lead").agg(F.min("key").alias("next"))
        members = written(rest.join(least, "lead").select(F.col("next").alias("lead"), "key", "n"), "large-groups")
    return links


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id for each row of docs.

    Documents link when den * |A and B| >= num * |A or B| for their sets of distinct n-word shingles, words in
    lower case A-Z; a text with fewer words has its whole sequence as its one shingle, and one without words (or
    null) has no shingle and links with nothing. component_id is the smallest id that links reach, the row's own
    included. Ids are integers; a row with a null id counts for none and has a null component unless its text is
    another's. Rows that repeat an id are one document. An empty table gives an empty result; other columns are
    ignored. Sets are compared as 64-bit hashes of their shingles."""
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    made = written(base.mapInArrow(_signatures(n), "id long, digest binary, n long, token long, count long"), "signatures")
    top = made.where("token is not null").groupBy("token").agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "token").limit(HEAVY)
    top = top.toArrow()  # at most HEAVY rows of 16 bytes
    tokens, counts = (top.column(c).to_numpy().astype(np.int64) for c in ("token", "count"))
    by = np.argsort(tokens.view(np.uint64))
    signatures = made.where("token is null").select("id", "digest", "n")
    classes = signatures.where("n > 0").groupBy("digest").agg(F.min("id").alias("first"))
    classes = written(_with_key(classes.where("first is not null")), "classes")
    hottest = np.sort(tokens[counts > max(HOT, classes.count() // HOT)].view(np.uint64))
    sent = spark.sparkContext.broadcast((tokens.view(np.uint64)[by], counts[by], hottest))

    def meetings() -> DataFrame:
        postings = written(base.mapInArrow(_postings(n, num, den, sent), "token long, hot boolean, key long, size int, place int"), "postings")
        sent.unpersist()  # the written postings are all that follows from it
        return _once(written(_met(postings, num, den), "met"))

    met = settled(spark, "met-once", meetings)
    found = settled(spark, "found", lambda: _linked(base, met, classes, n, num, den))
    rows = signatures.join(classes.drop("key"), "digest", "left").join(found.withColumnRenamed("node", "first"), "first", "left")
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("root", "first", "id").alias("component_id"))


def _linked(base: DataFrame, met: DataFrame, classes: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(node, root) of the sets that link, by the first ids of their classes."""
    members = met.union(met.select("lead", "lead").distinct())
    large = written(met.groupBy("lead").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= BLOCK).select("lead"), "large-leads")
    by_key = classes.select("key", F.col("first").alias("id"))
    of_large = members.join(large, "lead")
    wanted = of_large.select("key").distinct().join(by_key, "key")
    sets = written(_texts(base, wanted).select("id", "key", "text").mapInArrow(_large_sets(n), "key long, id long, set binary"), "large-sets")
    links = _large_groups(of_large, sets.dropDuplicates(["key"]), num, den)
    few = members.join(large, "lead", "left_anti").join(by_key, "key")
    placed = _texts(base, few).repartition("lead").sortWithinPartitions("lead")
    links.append(placed.select("id", "key", "lead", "text").mapInArrow(_of_texts(n, num, den), "a long, b long"))
    return components(functools.reduce(DataFrame.unionByName, links))


def _texts(base: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted with the texts of its ids; only wanted texts move."""
    return with_listed(base, written(wanted, "wanted-texts"), "id")


def _with_key(classes: DataFrame) -> DataFrame:
    """The key of a digest: its first eight bytes as a little-endian signed integer."""
    h = F.hex("digest")
    swapped = F.concat(*[F.substring(h, 2 * k + 1, 2) for k in range(7, -1, -1)])
    high, low = (F.conv(F.substring(swapped, k, 8), 16, 10).cast("long") for k in (1, 9))
    signed = F.when(high >= 2**31, high - 2**32).otherwise(high)
    return classes.withColumn("key", signed * F.lit(2**32) + low)


def drop_near_copies(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs of one document, that with the smallest id, of each component, and those with a null id. Rows that repeat
    an id are one document: they stay or go together."""
    gone = jaccard_components(docs, n, num, den, id_col, text_col).where(F.col(id_col) != F.col("component_id"))
    gone = gone.select(F.col(id_col).alias("__gone")).distinct()
    return without(docs, gone, docs[id_col] == F.col("__gone"), docs[id_col])

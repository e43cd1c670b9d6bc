"""The operators against brute force and the libraries, on small tables with odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, name string, id long, level long"
WORDS = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def corpus(seed=0):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    out = [None, "", " ", "a", "A", "a b", "a  b\t", "a b ", "x" * 9000, "x" * 9001, "<|endoftext|> it's  'll\n", "\x00é中😀 1²", "The end. " * 40]
    for _ in range(25):
        base = [rng.choice(vocab) for _ in range(rng.choice([4, 30, 90, 300]))]
        for _ in range(rng.choice([1, 2, 6])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            out.append(" ".join(w).capitalize())
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    for _ in range(6):
        out.append(" ".join(rng.choice(vocab) for _ in range(80)) + "\n" + passage + "\n" + " ".join(rng.choice(vocab) for _ in range(50)))
    return out, passage


@pytest.fixture(scope="module")
def texts():
    return corpus()[0]


@pytest.fixture(scope="module")
def docs(spark, texts):
    """Documents with columns that clash with the operators' own names."""
    return spark.createDataFrame([(k, t, "en", "n", 7, 1) for k, t in enumerate(texts)], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, texts, empty):
    from tidewater.llm.exact_dedup import drop_exact_copies, exact_dedup

    norm = [re.sub("[\x20\x09-\x0d]+", " ", t or "") for t in texts]
    for block in (4096, 3):
        some = docs if block > 3 else docs.where("length(text) < 200 or text is null")
        ids = [r["doc_id"] for r in some.collect()]
        group = {}
        for k in sorted(ids):
            group.setdefault(norm[k], []).append(k)
        want = {k: (group[norm[k]][0], len(group[norm[k]]), k == group[norm[k]][0], hashlib.sha256(norm[k].encode()).hexdigest()) for k in ids}
        assert {r["doc_id"]: tuple(r)[1:] for r in exact_dedup(some, block=block).collect()} == want
    assert drop_exact_copies(docs).columns == docs.columns
    assert exact_dedup(empty).count() == 0
    twice = exact_dedup(docs.where("doc_id = 3").union(docs.where("doc_id = 3")))
    assert [tuple(r)[:4] for r in twice.collect()] == [(3, 3, 2, True)] * 2


def test_exact_dedup_knows_rows_by_id_and_text(spark, monkeypatch):
    from tidewater.llm import exact_dedup, spread

    rows = [(1, "A"), (5, "A"), (5, "B"), (None, "A"), (None, "C"), (7, "A ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for listed in (100_000, 0):
        monkeypatch.setattr(spread, "LISTED", listed)
        kept = [tuple(r) for r in exact_dedup.drop_exact_copies(docs).collect()]
        assert sorted(kept, key=str) == sorted([(1, "A"), (5, "B"), (None, "C"), (7, "A ")], key=str)


def test_exact_dedup_of_very_long_texts(spark):
    import time

    from tidewater.llm.exact_dedup import exact_dedup

    long = "".join(random.Random(0).choices("abcdefghij \n", k=4_000_000))
    docs = spark.createDataFrame([(1, long), (2, long + "x"), (3, long), (4, "x")], "doc_id long, text string").repartition(4)
    began = time.time()
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup(docs).collect()}
    assert got == {1: (1, 2), 2: (2, 1), 3: (1, 2), 4: (4, 1)} and time.time() - began < 60


def brute_components(texts, n, num, den):
    sets = []
    for t in texts:
        w = WORDS.findall((t or "").translate(LOWER))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]) and root(i) != root(j):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {k: (len(s), root(k)) for k, s in enumerate(sets)}


@pytest.mark.parametrize("n,num,block", [(4, 85, 512), (5, 80, 2)])
def test_jaccard_components(docs, texts, empty, monkeypatch, n, num, block):
    from tidewater.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "PART", 16 if block > 2 else 3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs, n, num, 100).collect()}
    assert got == brute_components(texts, n, num, 100)
    if block > 2:
        assert jaccard_join.jaccard_components(empty, n, num, 100).count() == 0
        assert jaccard_join.drop_near_copies(docs, n, num, 100).columns == docs.columns


def test_jaccard_of_unlike_long_words(spark):
    """Two words of 4,096 letters without a common shingle, on which polynomial hashes modulo 2^64 are equal."""
    from tidewater.llm.jaccard_join import jaccard_components

    one = "".join("ab"[k.bit_count() & 1] for k in range(4096))
    docs = spark.createDataFrame([(1, one), (2, one.translate(str.maketrans("ab", "ba")))], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in jaccard_components(docs).collect()} == {1: 1, 2: 2}


def test_jaccard_of_many_near_copies(spark, monkeypatch):
    """Groups beyond a block, with members that link to the lead, to others only, and to none; hot lists apart."""
    from tidewater.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    monkeypatch.setattr(jaccard_join, "PART", 4)
    rng = random.Random(5)
    texts = []
    for changes in (1, 3, 6, 12):
        base = [f"v{rng.randrange(10**6)}" for _ in range(60)]
        for k in range(60):
            w = list(base)
            if k % 7 == 6:
                base = w  # the copies drift
            for _ in range(rng.randrange(changes + 1)):
                w[rng.randrange(60)] = f"v{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(3)
    want = brute_components(texts, 4, 85, 100)
    for hot in (1000, 5):
        monkeypatch.setattr(jaccard_join, "HOT", hot)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs, 4, 85, 100).collect()}
        assert got == want


def test_jaccard_moves_few_texts_of_unlike_sets(spark, monkeypatch):
    """Long texts of fitting sizes that share a phrase or a third of their words, and copies that all meet each other: only the
    copies' texts move, once each. With short parts and lists of many sizes the links stay the same."""
    from tidewater.llm import jaccard_join

    moved, write = [], jaccard_join.written

    def spy(df, name):
        out = write(df, name)
        if name == "wanted-texts":
            moved.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "written", spy)
    rng = random.Random(11)
    phrases = [[f"p{x}-{k}" for k in range(5)] for x in range(12)]
    texts = []
    for k in range(120):
        w = [f"w{rng.randrange(10**7)}" for _ in range(rng.choice((200, 234, 260, 300, 350)))]
        for p in rng.sample(phrases, 4):
            at = rng.randrange(len(w))
            w[at:at] = p
        texts.append(" ".join(w))
    base = [f"v{k}" for k in range(200)]
    for k in range(24):
        texts.append(" ".join([*base[: 10 * (k % 3) // 2], f"x{k}", *base[10 * (k % 3) // 2 :]]))
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(3)
    want = brute_components(texts, 4, 85, 100)
    assert len({c for _, c in want.values()}) == 121
    for part in (32, 4):
        monkeypatch.setattr(jaccard_join, "PART", part)
        moved.clear()
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs, 4, 85, 100).collect()}
        assert got == want
        assert part == 4 or sum(moved) <= 40


def test_link_sets_on_large_groups():
    from tidewater.llm.jaccard_join import link_sets

    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**62, 100, dtype=np.uint64)
    sets = []
    for _ in range(150):
        s = base.copy()
        at = rng.integers(0, 100, rng.integers(0, 15))
        s[at] = rng.integers(0, 2**62, len(at), dtype=np.uint64)
        sets.append(np.unique(s))
    up = list(range(150))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(150):
        for j in range(i):
            c = len(np.intersect1d(sets[i], sets[j]))
            if 100 * c >= 85 * (len(sets[i]) + len(sets[j]) - c):
                up[root(i)] = root(j)
    own = [root(k) for k in range(150)]
    forest = link_sets(sets, 85, 100)
    up = list(range(150))
    for a, b in forest:
        assert root(a) != root(b)
        up[root(a)] = root(b)
    assert all((own[i] == own[j]) == (root(i) == root(j)) for i in range(150) for j in range(i))


def test_components(spark):
    from tidewater.llm.links import components

    path = [(k, k + 1) for k in range(300)] + [(1000, 999), (999, 1000), (5000, 5001), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(path, "a long, b long").repartition(5)).collect()}
    assert got == {**{k: 0 for k in range(301)}, 999: 999, 1000: 999, 5000: 5000, 5001: 5000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_substring_dedup(docs, texts, empty):
    from tidewater.llm.substring_dedup import drop_repeated_passages, substring_dedup

    passage = corpus()[1].split()
    rows = {r["doc_id"]: r for r in substring_dedup(docs).collect()}
    assert len(rows) == len(texts) and rows[0]["kept_text"] is None and rows[1]["kept_text"] == ""
    holders = [k for k, t in enumerate(texts) if t and " ".join(passage) in t]
    grams = {" ".join(passage[k : k + 50]) for k in range(len(passage) - 49)}
    assert len(holders) == 6
    for k in holders:
        text = " ".join(rows[k]["kept_text"].split())
        assert any(g in text for g in grams) == (k == holders[0])
    for k, r in rows.items():
        data = (texts[k] or "").encode()
        kept, last = b"", 0
        for a, e in r["removed_spans"]:
            kept, last = kept + data[last:a], e
        assert (kept + data[last:]).decode() == (r["kept_text"] or "") and r["n_bytes"] == len(data)
    alone = substring_dedup(docs.where(F.col("doc_id").isin(8, holders[0]))).collect()
    assert all(r["removed_bytes"] == 0 for r in alone)
    assert substring_dedup(empty).count() == 0 and drop_repeated_passages(docs).columns == docs.columns


def plain_substring_dedup(rows, least_words):
    """Byte by byte and chunk by chunk: the gear hash, the ends of chunks, owners, runs, what stays."""
    from tidewater.llm import substring_dedup as S

    space, gear = b" \t\n\x0b\x0c\r", [int(g) for g in S._GEAR]

    def chunks(data):
        out, h, last, blank = [], 0, 0, 0
        for k, c in enumerate(data):
            h = ((h << 1) + gear[c]) & 0xFFFFFFFF
            if c in space:
                blank = k
            end, following = k + 1, data[k + 1] if k + 1 < len(data) else None
            after_space = c in space and (following is None or following not in space) and h >> (32 - S.TOP_BITS) == 0
            unspaced = k - blank >= S.UNSPACED and (following is None or following & 0xC0 != 0x80) and h >> (32 - S.UNSPACED_BITS) == 0
            if after_space or unspaced or end == len(data):
                while end - last > S.MOST:
                    cut = last + S.MOST
                    while data[cut] & 0xC0 == 0x80 and cut > last + 1:
                        cut -= 1
                    out.append((last, cut))
                    last = cut
                if end - last >= S.LEAST and end < len(data) or end == len(data) > last:
                    out.append((last, end))
                    last = end
        return out

    owner = {}
    for i, t in sorted((i, t or "") for i, t in rows if i is not None):
        for a, e in chunks(t.encode()):
            owner.setdefault(t.encode()[a:e], i)
    result = []
    for i, t in rows:
        data, kept, run = (t or "").encode(), b"", []
        for a, e in [*chunks(data), (len(data), len(data))]:
            if i is not None and a < e and owner[data[a:e]] != i:
                run.append((a, e))
                continue
            if run:
                passage = data[run[0][0] : run[-1][1]]
                if sum(1 if len(w) <= S.WORD else len(w) // S.PART for w in passage.split()) < least_words:
                    kept += passage
            kept, run = kept + data[a:e], []
        result.append((i, None if t is None else kept.decode()))
    return result


def test_substring_dedup_equals_plain_version(spark, texts):
    from tidewater.llm.substring_dedup import drop_repeated_passages, substring_dedup

    rng = random.Random(9)
    chinese = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(400))
    other = lambda: "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(rng.randrange(100)))
    code = "".join(rng.choices("abcdefghij0123456789+/", k=900))
    rows = [*enumerate(texts), *((200 + k, other() + chinese + other()) for k in range(3)), (300, "see " + code), (301, "x" + code + " end"), (None, texts[-1]), (302, None), (302, texts[-1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for least in (5, 25):
        got = [(r["doc_id"], r["kept_text"]) for r in substring_dedup(docs, least_words=least).collect()]
        assert sorted(got, key=str) == sorted(plain_substring_dedup(rows, least), key=str)
    kept = {r["doc_id"]: r["kept_text"] for r in substring_dedup(docs).where("doc_id between 201 and 301").collect()}
    assert all(len(kept[k]) < len(rows_k) - 300 for k, rows_k in dict(rows[len(texts) + 1 : len(texts) + 3]).items()) and len(kept[301]) < 300
    named = docs.selectExpr("doc_id", "text", "77 as n_bytes", "'x' as kept_text", "5 as c0", "1 as foreign")
    out = drop_repeated_passages(named)
    assert out.columns == named.columns and {tuple(r)[2:] for r in out.collect()} == {(77, "x", 5, 1)}


def test_boundaries_resist_shifts():
    from tidewater.llm.substring_dedup import boundaries

    rng = random.Random(1)
    body = (" ".join(f"w{rng.randrange(9999)}" for _ in range(300))).encode()
    data = lambda b: np.frombuffer(b, dtype=np.uint8)
    one = boundaries(data(body), np.array([0, len(body)]))[0]
    head = b"something put before it "
    two = boundaries(data(head + body), np.array([0, len(head) + len(body)]))[0] - len(head)
    assert len(set(one.tolist()) & set(two.tolist())) > 0.9 * len(one)
    long = boundaries(data(b"x" * 3000), np.array([0, 3000]))[0]
    assert np.diff(long, prepend=0).max() <= 512 and long[-1] == 3000


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    return path, Tokenizer.from_file(path)


def test_token_counts(docs, texts, empty, tokenizer):
    from tidewater.llm.token_counts import count_tokens

    path, library = tokenizer
    for r in count_tokens(docs, path).collect():
        t = texts[r["doc_id"]] or ""
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 1024)
    assert count_tokens(empty, path).count() == 0


def test_split_equals_library(tokenizer):
    import pyarrow as pa

    from tidewater.llm import bytepairs

    path, library = tokenizer
    rng = random.Random(4)
    alphabet = "  \n\t'sstdmreveLl'aé中1²٣  !?<|endoftext|>  　😀x"
    odd = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(3000)] + ["<|endoftext|>" * 3, "\x01\x02 a"]
    kinds = bytepairs.classes()
    got = [x.tolist() for x in bytepairs.token_ids(pa.array(odd, pa.large_string()), path, kinds)]
    assert got == [x.ids for x in library.encode_batch(odd, add_special_tokens=False)]


def test_long_pretokens_equal_library(tokenizer):
    import time

    import pyarrow as pa

    from tidewater.llm import bytepairs

    path, library = tokenizer
    rng = random.Random(7)
    odd = ["".join(rng.choice(a) for _ in range(n)) for a in ("ab", "abcdefghijklmnopqrstuvwxyz", "ACGT", "aé中") for n in (127, 128, 129, 1000, 5000)]
    odd += ["a" * 1000, "ab" * 700, "\n" * 400, "=" * 333, "the" * 500]
    kinds = bytepairs.classes()
    got = [x.tolist() for x in bytepairs.token_ids(pa.array(odd, pa.large_string()), path, kinds)]
    assert got == [x.ids for x in library.encode_batch(odd, add_special_tokens=False)]
    began = time.time()
    long = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))
    n = bytepairs.token_counts(pa.array([long]), path, kinds)
    assert time.time() - began < 20 and n[0] == len(library.encode(long, add_special_tokens=False).ids)


def test_packing_keeps_ids_beside_null(spark, tokenizer):
    from tidewater.llm import packing

    ids = [2**60 + 1, None, 2**60 + 3, 2**60 + 3]
    docs = spark.createDataFrame([(i, "some text") for i in ids], "doc_id long, text string").repartition(3)
    rows = packing.pack(docs, tokenizer[0]).collect()
    assert sorted([r["doc_id"] for r in rows], key=str) == sorted(ids, key=str) and all(r["length"] == r["doc_tokens"] for r in rows)
    assert len({r["sequence_id"] for r in rows}) == 1


def test_packing(docs, texts, empty, tokenizer, monkeypatch):
    from tidewater.llm import packing

    path, library = tokenizer
    for length in (2048, 64):
        rows = packing.pack(docs, path, length=length, most_open=4).collect()
        by_doc, by_seq = {}, {}
        for r in rows:
            by_doc.setdefault(r["doc_id"], []).append(r)
            by_seq.setdefault(r["sequence_id"], []).append(r)
        assert set(by_doc) == set(range(len(texts)))
        for k, pieces in by_doc.items():
            ids = np.array([*library.encode(texts[k] or "", add_special_tokens=False).ids, 1], dtype="<u4")
            at = 0
            for r in sorted(pieces, key=lambda r: r["start"]):
                assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
                at += r["length"]
            assert at == len(ids)
        for pieces in by_seq.values():
            at = 0
            for r in sorted(pieces, key=lambda r: r["offset"]):
                assert r["offset"] == at
                at += r["length"]
            assert at <= length
        assert sum(sum(r["length"] for r in p) < length for p in by_seq.values()) <= 1
    assert packing.pack(empty, path).count() == 0


def test_sentencepiece(docs, texts, empty):
    import public_tokenizers
    import pyarrow as pa
    import sentencepiece

    from tidewater.llm import sentencepieces

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    for r in sentencepieces.round_trip(docs, path).collect():
        ids = library.encode(texts[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    back = sentencepieces.decode(sentencepieces.encode(docs, path), path).collect()
    assert {r["doc_id"]: r["text"] for r in back} == {k: t or "" for k, t in enumerate(texts)}
    assert sentencepieces.round_trip(empty, path).count() == 0
    v = sentencepieces.Vocabulary(path)
    rng = random.Random(3)
    odd = ["".join(rng.choice("  \n'ab the▁中é😀<s>\x00") for _ in range(rng.randrange(25))) for _ in range(2000)]
    assert [x.tolist() for x in v.encode(pa.array(odd))] == library.encode(odd)


def test_warc(spark, tmp_path):
    from tidewater.llm import warc

    big = "<p>" + "é" * 200 + "</p>"
    rows = [(1, "http://a/é b", None, 0), (2, None, "short", 0), (3, "u", "short", 0), (9, "u", big, 0), (4, "u\r\nX: y", big, 0), (5, "u", big, 0), (None, "u", big, 0), (None, "u", "z" * 300, 0), (6, "u", "\r\n\r\n" * 60, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int").repartition(3)
    folder = f"file://{tmp_path}/w"
    index = warc.write(pages, folder)
    got = warc.read(index, folder).collect()
    assert len(got) == len(rows)
    seen = sorted(((r["id"] or -1, r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got), key=str)
    b = len(big.encode())
    assert seen == sorted([(1, 0, "response", None), (2, 5, "response", None), (3, 5, "response", None), (9, b, "revisit", 4), (4, b, "response", None), (5, b, "revisit", 4), (-1, b, "revisit", 4), (-1, 300, "response", None), (6, 240, "response", None)], key=str)
    for r in got:
        if r["record_type"] == "response":
            assert hashlib.sha256(bytes(r["payload"])).hexdigest() == r["payload_digest"]
    import zstandard

    for f in (tmp_path / "w").glob("*.zst"):  # any zstd reader can read a bundle
        assert zstandard.ZstdDecompressor().stream_reader(f.open("rb"), read_across_frames=True).read().startswith(b"WARC/1.1")
    assert warc.read(warc.write(pages.limit(0), folder), folder).count() == 0


def test_embedding_links(spark):
    from tidewater.llm.embedding_dedup import embedding_links

    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 64))
    for k in range(0, 200, 4):
        x[k + 1 : k + 4] = x[k] + rng.normal(size=(3, 64)) * 0.25
    odd = [(900, None), (901, []), (902, [0.0] * 64), (903, [float("nan")] * 64), (904, [1.0, None]), (905, [1.0, 2.0]), (906, [2.0, 4.0]), (None, [1.0] * 64)]
    rows = [(k, v.tolist()) for k, v in enumerate(x.astype(np.float32))] + odd
    got = {r["vec_id"]: r for r in embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    g = u @ u.T >= 0.9
    want = g.sum(1) - 1
    assert len(got) == len(rows)
    assert sum(got[k]["n_links"] for k in range(400)) >= 0.97 * want.sum() and all(got[k]["n_links"] <= want[k] for k in range(400))
    assert all(got[k]["kept"] == (got[k]["component_id"] == k) for k in range(400))
    assert all(got[k]["n_links"] == 0 for k in (900, 901, 902, 903, 904, None)) and got[906]["component_id"] == 905


def test_embedding_links_of_equal_and_extreme_vectors(spark, monkeypatch):
    """Doubles beyond what squares hold, copies in buckets beyond a block, ids with several vectors."""
    from tidewater.llm import embedding_dedup

    monkeypatch.setattr(embedding_dedup, "BLOCK", 8)
    x, y = [1e300, 1e300, 0.0], [0.0, 1e-300, 1e-300]
    rows = [(k, x) for k in range(30)] + [(k, y) for k in range(30, 35)] + [(40, x), (40, y), (40, y), (41, [float("inf"), 1.0, 1.0]), (42, [1e300, 0.9e300, 0.0])]
    rows = [(k, v, 0, "c") for k, v in rows]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, weight int, class string").repartition(4)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.embedding_links(d).collect()}
    # x: 29 others, 40 and 42; y: 4 others and 40; 40: what each of its vectors links with
    assert got[3] == (31, 0) and got[42] == (31, 0) and got[33] == (5, 0) and got[40] == (36, 0) and got[41] == (0, 41)
    assert embedding_dedup.embedding_links(d.limit(0)).count() == 0


def test_embedding_recall(spark):
    """Each twentieth vector against all, by brute force: given ones and a neighbour for each, at cosines from 0.9 on."""
    from tidewater.llm.embedding_dedup import embedding_links

    given = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").select("embedding").toPandas().embedding
    x = np.stack([np.asarray(v, dtype=float) for v in given])
    rng = np.random.default_rng(12)
    noise = rng.normal(size=x.shape)
    noise -= (noise * x).sum(1)[:, None] / (x * x).sum(1)[:, None] * x
    aim = rng.uniform(0.9, 0.97, len(x))
    near = x + noise * (np.linalg.norm(x, axis=1) / np.linalg.norm(noise, axis=1) * np.sqrt(1 / aim**2 - 1))[:, None]
    x = np.concatenate([x, near]).astype(np.float32)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    asked = np.arange(0, len(x), 20)
    want = dict(zip(asked.tolist(), ((u[asked] @ u.T) >= 0.9).sum(1) - 1))
    d = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r["n_links"] for r in embedding_links(d).where("vec_id % 20 = 0").collect()}
    assert set(got) == set(want) and all(got[k] <= want[k] for k in want)
    assert sum(got.values()) >= 0.98 * sum(want.values()) > 0


def test_estimates_are_unbiased_and_bounded():
    from tidewater.llm.embedding_dedup import Codes, coded

    rng = np.random.default_rng(2)
    v = rng.normal(size=(300, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    c = Codes(v, *coded(v))
    value, bound = c.estimates(np.arange(300), np.arange(300))
    error = (value - v @ v.T)[~np.eye(300, dtype=bool)]
    assert abs(error.mean()) < 0.01 and (np.abs(error) < bound[~np.eye(300, dtype=bool)]).mean() > 0.999


def test_quality(spark):
    from tidewater.llm.quality import fit, held_out, measured, quality, score

    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality(d, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in got]) > 0.9
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in quality(d, labels).limit(50).collect())
    model = fit(measured(d.where(~held_out())), labels)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 100000), (4, "\x00")], "doc_id long, text string")
    assert all(0 <= r["score"] <= 1 for r in score(odd, model).collect())
    assert quality(d.limit(0), labels).count() == 0
    with pytest.raises(ValueError):
        fit(measured(d), labels.where("quality = 1"))


def plain_statistics(text):
    """The statistics of quality.FEATURES for one text, count by count."""
    import math

    data = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0d]+", data)
    letter = lambda c: 65 <= c <= 90 or 97 <= c <= 122 or c >= 128
    plain = b".,;:!?'\"()-"
    odd = lambda c: not (letter(c) or 48 <= c <= 57 or c in plain or c in b" \t\n\x0b\x0c\r")
    logit = lambda part, of: math.log((part + 0.5) / (max(of - part, 0) + 0.5))
    n, b, sizes = len(words), len(data), [len(w) for w in words]
    mean = sum(sizes) / max(n, 1)
    spread = math.sqrt(max(sum(x * x for x in sizes) / max(n, 1) - mean**2, 0))
    upper = lambda c: 65 <= c <= 90
    count = lambda f: sum(map(f, data))
    of_words = lambda f: logit(sum(map(f, words)), n)
    return [
        math.log1p(n), math.log1p(mean), math.log1p(spread), logit(count(odd), b), logit(count(lambda c: 48 <= c <= 57), b),
        logit(count(lambda c: c in plain), b), logit(count(upper), b), logit(data.count(b"\n"), b), logit(len({*words}), n),
        logit(max((words.count(w) for w in {*words}), default=0), n), logit(sum(x == y for x, y in zip(words, words[1:])), n),
        of_words(lambda w: len(w) == 1 and odd(w[0])), of_words(lambda w: odd(w[-1])), of_words(lambda w: w[-1] in b".!?"),
        of_words(lambda w: len(w) > 20), of_words(lambda w: upper(w[0])),
    ]


def test_quality_equals_plain_version(spark):
    """Statistics, class means, shrunk covariances and scores computed once more, by determinants and inverses."""
    from tidewater.llm.quality import TO_DIAGONAL, TO_IDENTITY, quality

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    docs = [(r["doc_id"], r["text"]) for r in rows] + [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "x" * 300_000), (None, "a b"), (rows[0]["doc_id"], rows[0]["text"])]
    odd = spark.createDataFrame([(*d, 0.5, 1) for d in docs], "doc_id long, text string, score double, id int").repartition(3)
    labels = spark.createDataFrame([*marks.items(), (10**6, None)], "doc_id long, quality int")
    x = np.array([plain_statistics(t) for _, t in docs])
    held = [i is not None and zlib.crc32(str(i).encode()) % 4 == 2 for i, _ in docs]
    density, n = [], []
    for k in (0, 1):
        own = x[[i in marks and marks[i] == k and not h for (i, _), h in zip(docs, held)]]
        c = np.cov(own.T, bias=True)
        c = (1 - TO_DIAGONAL) * c + TO_DIAGONAL * np.diag(np.diag(c))
        c = (1 - TO_IDENTITY) * c + (TO_IDENTITY * np.trace(c) / len(c) + 1e-9) * np.eye(len(c))
        off = x - own.mean(0)
        density.append(-0.5 * ((off @ np.linalg.inv(c)) * off).sum(1) - 0.5 * np.log(np.linalg.det(c)))
        n.append(len(own))
    want = 1 / (1 + np.exp(-np.clip(density[1] - density[0] + np.log(n[1] / n[0]), -500, 500)))
    got = quality(odd, labels).collect()
    assert len(got) == len(docs) and sorted((r["doc_id"], r["held_out"]) for r in got if r["doc_id"] is not None) == sorted((i, h) for (i, _), h in zip(docs, held) if i is not None)
    by_id = {i: w for (i, _), w in zip(docs, want)}
    assert all(abs(r["score"] - by_id[r["doc_id"]]) < 2e-3 and r["predicted"] == (r["score"] >= 0.7) for r in got)


def test_lm_scoring_equals_brute_force(spark, docs, texts, empty):
    from tidewater.llm.lm_scoring import cross_entropy_difference

    wanted = spark.createDataFrame([(k,) for k in range(20, 40)], "doc_id long")
    size = 50
    words = [WORDS.findall((t or "").translate(LOWER)) for t in texts]
    from collections import Counter

    from tidewater.llm.textarrays import span_hashes

    def h(w):
        b = np.frombuffer(w.encode(), dtype=np.uint8)
        return int(span_hashes(b, np.array([0]), np.array([len(b)])).view(np.int64)[0])

    count = Counter(w for ws in words for w in ws)
    vocabulary = {w for w, _ in sorted(count.items(), key=lambda x: (-x[1], h(x[0])))[:size]}
    seqs = [["<s>", *[w if w in vocabulary else "<unk>" for w in ws]] for ws in words]

    def model(ids):
        pairs = Counter((a, b) for k in ids for a, b in zip(seqs[k], seqs[k][1:]))
        single, seen, kinds = Counter(), Counter(), Counter()
        for (a, b), n in pairs.items():
            single[b] += n
            seen[a] += n
            kinds[a] += 1
        total = sum(single.values()) + size + 1
        weight = lambda a: kinds[a] / (seen[a] + kinds[a]) if seen[a] else 1.0
        return lambda a, b: -np.log((1 - weight(a)) * pairs[a, b] / max(seen[a], 1) + weight(a) * (single[b] + 1) / total)

    target, background = model(range(20, 40)), model(range(len(texts)))
    for r in cross_entropy_difference(docs, wanted, size=size).collect():
        s = seqs[r["doc_id"]]
        n = len(s) - 1
        assert r["n_words"] == n
        for name, loss in (("target_loss", target), ("background_loss", background)):
            assert np.isclose(r[name], sum(loss(a, b) for a, b in zip(s, s[1:])) / max(n, 1), rtol=1e-4, atol=1e-6)
    assert cross_entropy_difference(empty, wanted).count() == 0


def test_lm_scoring_tells_rare_words(spark, monkeypatch):
    """The vocabulary has no size: words that more than a thousand others outnumber still tell documents apart."""
    from collections import Counter

    from tidewater.llm import lm_scoring
    from tidewater.llm.lm_scoring import cross_entropy_difference

    monkeypatch.setattr(lm_scoring, "SMALL_BYTES", 1000)  # several blocks and parts
    common = " ".join(f"c{k}" for k in range(1500))
    texts = [common, common, "rare one", "other two", "rare one", "other two", "", None]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    rows = {r["doc_id"]: r for r in cross_entropy_difference(docs, spark.createDataFrame([(2,)], "doc_id long")).collect()}
    assert len(rows) == len(texts) and rows[4]["score"] < rows[5]["score"] - 0.1 and rows[6]["n_words"] == rows[7]["score"] == 0
    seqs = [["<s>", *(t or "").split()] for t in texts]

    def loss(ids, k):
        pairs = Counter(p for i in ids for p in zip(seqs[i], seqs[i][1:]))
        single, seen, kinds = Counter(), Counter(), Counter()
        for (a, b), n in pairs.items():
            single[b], seen[a], kinds[a] = single[b] + n, seen[a] + n, kinds[a] + 1
        total, s = sum(single.values()) + 1504 + 1, 0.0
        for a, b in zip(seqs[k], seqs[k][1:]):
            w = kinds[a] / (seen[a] + kinds[a]) if seen[a] else 1.0
            s -= np.log((1 - w) * pairs[a, b] / max(seen[a], 1) + w * (single[b] + 1) / total)
        return s / max(len(seqs[k]) - 1, 1)

    for k, r in rows.items():
        assert np.isclose(r["target_loss"], loss([2], k)) and np.isclose(r["background_loss"], loss(range(len(texts)), k))


def test_removed_passages_do_not_depend_on_neighbours(spark):
    from tidewater.llm.substring_dedup import boundaries, substring_dedup

    rng = random.Random(4)
    some = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    data = lambda s: np.frombuffer(s.encode(), dtype=np.uint8)
    texts = []
    for _ in range(60):
        passage = some(60)
        texts += [f"{some(rng.randrange(40))} {passage} {some(30)}" for _ in range(2)]
    for a, b in zip(texts, texts[1:]):
        alone = boundaries(data(b), np.array([0, len(b)]))[0]
        assert np.array_equal(boundaries(data(a + b), np.array([0, len(a), len(a + b)]))[1] - len(a), alone)
    results = []
    for seed, parts in ((1, 2), (2, 5)):
        rows = [*enumerate(texts)]
        random.Random(seed).shuffle(rows)
        out = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), least_words=15).collect()
        results.append({r["doc_id"]: r["removed_spans"] for r in out})
        for k, spans in results[-1].items():
            assert len(spans) == k % 2
            for a, e in spans:
                assert texts[k].encode()[a:e] in texts[k - 1].encode()
    assert results[0] == results[1]


def test_span_hashes(monkeypatch):
    from tidewater.llm import textarrays

    rng = random.Random(11)
    spans = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 12))) for _ in range(3000)] + ["x" * 50, "x" * 51, "é中"]

    def hashes():
        data = np.frombuffer(" ".join(spans).encode(), dtype=np.uint8)
        ends = np.append(np.flatnonzero(data == 32), len(data))
        return textarrays.span_hashes(data, np.concatenate([[0], ends[:-1] + 1]), ends).tolist()

    whole = hashes()
    assert len({*zip(spans, whole)}) == len({*spans}) == len({*whole})
    monkeypatch.setattr(textarrays, "WINDOW", 40)
    cut = hashes()
    assert [c == w for c, w in zip(cut, whole)] == [len(x.encode()) <= 40 for x in spans] and len({*zip(spans, cut)}) == len({*cut})


def test_shingle_sets_of_few_words():
    import pyarrow as pa

    from tidewater.llm.textarrays import SLICE_BYTES, raw, shingle_sets, slices

    for texts in (["a b"], ["a b c"], ["a"], [""], ["a b", "x " * SLICE_BYTES], ["a b c", "x " * SLICE_BYTES]):
        for n in (4, 5):
            data, at = raw(pa.array([*texts, "a b", "a b c"]))
            together = shingle_sets(data, at, n)
            own = []
            data, at = raw(pa.array(texts))
            for i, j in slices(at):
                own += shingle_sets(data[at[i] : at[j]], at[i : j + 1] - at[i], n)
            assert all(np.array_equal(x, y) for x, y in zip(own, together)) and len(own) == len(texts)

"""The pipeline's stages on sf0.001: each keeps what a brute-force version of its decision keeps."""

import re

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.test_ops import brute_components, plain_substring_dedup


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, None
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        rows = {r["doc_id"]: r["text"] for r in before.collect()}
        if k < 4:
            assert docs.columns == columns
        kept = {r["doc_id"] for r in docs.collect()}
        if k == 0:
            assert 0.6 * len(rows) < len(kept) < len(rows)
        if k == 1:
            first = {}
            for i in sorted(rows):
                first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", rows[i] or ""), i)
            assert kept == set(first.values())
        if k == 2:
            ids = sorted(rows)
            comp = brute_components([rows[i] for i in ids], 5, 80, 100)
            assert kept == {ids[i] for i, (_, root) in comp.items() if i == root}
        if k == 3:
            assert sorted((r["doc_id"], r["text"]) for r in docs.collect()) == sorted(plain_substring_dedup([*rows.items()], 25))
        if k == 4:
            size = {r["doc_id"]: r["n"] for r in docs.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
            library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.VOCABULARY))
            assert size == {i: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in rows.items()}
    assert docs.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0


def test_near_copies_of_unlike_long_texts(spark, monkeypatch):
    """Texts whose sizes just fit each other and that share a phrase: none but those of copies move."""
    from tidewater.llm import jaccard_join

    moved, write = [], jaccard_join.written

    def spy(df, name):
        out = write(df, name)
        if name == "wanted-texts":
            moved.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "written", spy)
    phrase = [" ".join(f"p{k}-{j}" for j in range(80)) for k in range(15)]
    texts = [" ".join([phrase[k % 15]] + [f"w{k}-{j}" for j in range(420 if k < 15 else 535)]) for k in range(30)]
    texts += [texts[0] + " more", texts[1] + " and more"]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(3)
    assert {r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, "").collect()} == {*range(30)}
    assert sum(moved) <= 8


def test_run(spark, sf):
    """The rows of the stages, and no table left but the last stage's and its documents."""
    from pathlib import Path

    from tidewater.storage import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file://"))
    before = {p.name for p in folder.iterdir()}
    assert corpus_pipeline.run(spark, sf).count() > 0
    left = {p.name.rsplit("-", 1)[0] for p in folder.iterdir() if p.name not in before}
    assert left == {"stage-3", "pieces"}


def test_long_lists_move_no_other_texts(spark, monkeypatch):
    """More copies than a list holds: they go, and the texts of all other rows, null ids too, stay where they are."""
    import random

    from tidewater.llm import jaccard_join, spread

    monkeypatch.setattr(spread, "LISTED", 10)
    monkeypatch.setattr(jaccard_join, "LISTED", 10, raising=False)
    chance = random.Random(3)
    texts = [" ".join("".join(chr(chance.randrange(0x4E00, 0x9000)) for _ in range(50)) for _ in range(20)) for _ in range(600)]
    rows, copies, near = [*enumerate(texts), (None, "no id"), (2000, None)], [(1000 + i, t) for i, t in enumerate(texts[:30])], [(1500 + i, t + " more") for i, t in enumerate(texts[:30])]
    docs = spark.createDataFrame(rows + copies + near, "doc_id long, text string").repartition(4).localCheckpoint()
    size = sum(len((t or "").encode()) for _, t in rows)

    def moved():
        return sum(x.shuffleWriteBytes() for x in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)))

    # exact_copies groups the distinct blocks by their content first
    for stage, kept, most in ((corpus_pipeline.exact_copies, rows + near, 1.5), (corpus_pipeline.near_copies, rows, 0.5)):
        before = moved()
        assert sorted(stage(spark, docs, "").collect(), key=str) == sorted(kept, key=str)
        assert moved() - before < most * size


def test_written_leaves_no_shuffle_files(spark):
    import time

    from tidewater.storage import CLEANUP, settled, shared_dir, written

    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {x for x in disk.getAllFiles().mkString(" ").split() if "shuffle_" in x}
    before, kept = files(), spark.range(10_000).repartition(3, "id")
    out = written(kept.groupBy("id").count(), "counts")
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert out.count() == 10_000 and spark.conf.get(CLEANUP, None) is None
    inner = []
    total = settled(spark, "total", lambda: inner.append(written(out, "inner")) or inner[0].groupBy().sum("count"))
    assert total.first()[0] == 10_000
    from pathlib import Path

    left = {p.name.rsplit("-", 1)[0] for p in Path(shared_dir(spark).removeprefix("file://")).iterdir()}
    assert "total" in left and "inner" not in left


def test_near_copies_leave_no_postings(spark, sf):
    """The tables of prefixes and of sets go once their links are known."""
    from pathlib import Path

    from tidewater.llm.jaccard_join import jaccard_components
    from tidewater.storage import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file://"))
    before = {p.name for p in folder.iterdir()}
    assert jaccard_components(spark.read.parquet(f"{sf}/documents.parquet")).count() > 0
    assert {p.name.rsplit("-", 1)[0] for p in folder.iterdir() if p.name not in before} == {"signatures", "classes", "met-once", "found"}

"""Exact deduplication by deterministic block naming, in DataFrame operations only.

A normalised text is cut into blocks of a fixed number of characters. The distinct blocks of the corpus are
sorted and numbered; a document becomes a sequence of integer names. Then adjacent names are paired, the distinct
pairs are sorted and numbered again, and so on, until each document has one name. Names compare contents and not
digests, so two documents share their last name (of the same level) if and only if their texts are equal.

Blocks travel once: the distinct blocks are grouped by their content, after which a block is known by its
SHA-256, and the step that numbers them stops the job should two different blocks ever share one. Counting
and joining happen on integers. Groups of any size are handled by partial aggregation; where rows get the name of
their block, a block that many rows hold is dealt over several tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.spread import joined, without
from tidewater.storage import written

#: Characters in a block.
BLOCK = 4096
#: Each run of these becomes one space.
WHITE = r"[\x20\x09-\x0D]+"


def normalised(text: str):
    """Column: null as empty, each run of white space as one space."""
    return F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), WHITE, " ")


def _blocks(docs: DataFrame, block: int) -> DataFrame:
    """(id, sha, n, i, block): the blocks of each text, cut in one pass over it; an empty text has one empty block."""
    cut = F.regexp_extract_all("norm", F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    n = F.greatest(F.lit(1), F.ceil(F.length("norm") / F.lit(block))).cast("int")
    cut = docs.select("id", F.sha2(F.col("norm"), 256).alias("sha"), n.alias("n"), F.when(F.col("norm") == "", F.array(F.lit(""))).otherwise(cut).alias("all"))
    # the array is not carried along, and outer, though it is never empty: else Spark would cut each text once more to see that
    return cut.select("id", "sha", "n", F.posexplode_outer("all").alias("i", "block"))


def _numbered(distinct: DataFrame, *keys: str) -> DataFrame:
    """Each row's number in the order of the keys within its task; tasks number disjoint ranges."""
    return distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row for each row of docs: id, keep_id, group_size, kept, text_sha256.

    Equal: identical after each run of white space became one space. Null text counts as empty. The row with the
    smallest id of a group is kept. Rows that repeat an id with an equal text all count in group_size and share
    their fate; a null id is kept only if its group has no other. An empty table gives an empty result. Other
    columns are ignored, whatever their names."""
    base = docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("norm"))
    rows = _blocks(base, block)
    distinct = rows.groupBy("block").agg(F.count(F.lit(1)).alias("copies"))
    names = _numbered(distinct, "block").select(F.sha2(F.col("block"), 256).alias("digest"), "name", "copies")
    names = written(names, "block-names")
    # two different blocks with one digest would be two rows here
    clash = F.raise_error(F.lit("two blocks share a digest"))
    single = names.groupBy("digest").agg(F.min("name").alias("name"), F.max("name").alias("high"), F.sum("copies").alias("copies"))
    single = single.select("digest", "copies", F.when(F.col("name") == F.col("high"), F.col("name")).otherwise(clash.cast("long")).alias("name"))
    # the sequence of a text is identified by the first row that holds it only through names; ids may repeat,
    # so a row is known by (id, sha, length of the sequence) and rows alike in these are counted
    keyed = rows.select("id", "sha", "n", "i", F.sha2(F.col("block"), 256).alias("digest"))
    live = written(joined(keyed, single, ["digest"], F.xxhash64("id", "i")).select("id", "sha", "n", "i", "name"), "named-blocks")
    done = live.where("n = 1").select("id", "sha", F.lit(0).alias("level"), "name")
    level = 0
    live = live.where("n > 1").groupBy("id", "sha", "n", "i").agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("rows"))
    live = written(live, "sequences")
    parts = [done]
    while not live.isEmpty():
        level += 1
        half = F.floor(F.col("i") / 2).cast("int")
        pairs = live.groupBy("id", "sha", "n", "rows", half.alias("i")).agg(
            F.max(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("i") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
        )
        pairs = written(pairs.withColumn("n", F.ceil(F.col("n") / 2).cast("int")), "pairs")
        named = written(_numbered(pairs.groupBy("a", "b").agg(F.lit(1).alias("one")), "a", "b").select("a", "b", "name"), "pair-names")
        live = pairs.join(named, ["a", "b"]).select("id", "sha", "n", "rows", "i", "name")
        ended = live.where("n = 1").withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
        parts.append(ended.select("id", "sha", F.lit(level).alias("level"), "name"))
        live = live.where("n > 1")
    one = parts[0]
    for x in parts[1:]:
        one = one.unionByName(x)
    groups = one.groupBy("level", "name").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = written(groups, "text-groups")
    kept = F.col("id").eqNullSafe(F.col("keep_id"))
    return one.join(groups, ["level", "name"]).select(
        F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256")
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns; a row is known by its id and its text."""
    gone = exact_dedup(docs, id_col, text_col).where("not kept").select(F.col(id_col).alias("__gone"), F.col("text_sha256").alias("__sha"))
    # not as an equality: the text is hashed only where the id is listed
    same_text = F.instr(F.sha2(normalised(text_col), 256), F.col("__sha")) == 1
    return without(docs, gone.distinct(), docs[id_col].eqNullSafe(F.col("__gone")) & same_text, docs[id_col])

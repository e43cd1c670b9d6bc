"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm import warc

    folder = warc.new_archive(spark)
    index = warc.write(table(spark, sf_dir, "pages"), folder)
    records = warc.read(index, folder, payloads=False)
    return records.select(records["id"].alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest,
  CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND p.payload_bytes >= 100
"""


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidewater.llm.sentencepieces import round_trip

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.lm_scoring import cross_entropy_difference

    wanted = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0")
    return cross_entropy_difference(table(spark, sf_dir, "documents"), wanted)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.embedding_dedup import embedding_links

    return embedding_links(table(spark, sf_dir, "embeddings"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.llm.substring_dedup import substring_dedup

    cut = substring_dedup(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "kept_text", "n_chunks", "removed_chunks", "n_bytes", "removed_bytes", "removed_spans")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidewater.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidewater.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc, op2_sentencepiece, op3_lm_scoring, op4_jaccard_join, op5_embedding_dedup, op6_exact_dedup, op7_substring_dedup, op8_token_counts, op9_quality, op10_packing)}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op6_exact_dedup": OP6_SQL}

"""Token counts of whole texts by rank-synchronous array merging (see bytepairs.RankMerger)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm import bytepairs
from tidewater.llm.textarrays import raw

LIMIT = 1024


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit for each row of docs.

    vocabulary: path of a byte-level BPE file of the tokenizers library, the same on driver and executors.
    Counts are the library's without added special tokens; special strings inside a text count as one, as is its
    default. Null text counts as empty, with no tokens; null ids and repeated rows stay as they are; an empty
    table gives an empty result; other columns are ignored."""
    kinds = docs.sparkSession.sparkContext.broadcast(bytepairs.classes())  # 1.1 MB, fixed
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.diff(raw(b.column("text"))[1])
            n = bytepairs.token_counts(b.column("text"), vocabulary, kinds.value)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(size, pa.int64()), pa.array(n, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    out = rows.mapInArrow(count, f"id {kind.simpleString()}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

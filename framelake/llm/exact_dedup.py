"""Exact duplicates, by a heavy-hitter split (operator 7). DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import checkpointed, one_space, with_first


def text_digest(text: Column) -> Column:
    """SHA-256, lower-case hex, of the text with each run of white space made one space; null is empty."""
    return F.sha2(one_space(text).cast("binary"), 256)


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are read whole. Of equal texts the row with the smallest doc_id stays; a null doc_id is the largest; of
    repeated rows with that doc_id exactly one stays. Null and empty texts are equal, texts of white space alone are
    equal to each other (one space). An empty table gives an empty result. Other columns are not read.
    """
    rows = docs.select(F.col(doc_id).alias("_id"), text_digest(F.col(text)).alias("_digest"))
    rows = checkpointed(rows.withColumns({"_null": F.col("_id").isNull(), "_row": F.monotonically_increasing_id()}))
    out = with_first(rows, "_digest", ("_null", "_id", "_row"))
    return out.select(F.col("_id").alias("doc_id"), F.col("keep._id").alias("keep_id"), F.col("group_size").cast("long").alias("group_size"), (F.col("keep._row") == F.col("_row")).alias("kept"), F.col("_digest").alias("text_sha256"))

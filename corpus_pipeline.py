"""A training corpus from `documents`: toxic documents go, then exact copies, then near copies; sources are mixed and packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm import mixing, packing, simhash, toxicity
from framelake.llm.common import checkpointed, shared_dir, without_places
from framelake.llm.exact_dedup import exact_dedup
from framelake.sources.shared import remove


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go. The model is learned from the labels of sf_dir, without those held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~toxicity.held_out(F.col("doc_id")))
    return toxicity.without_toxic(docs, toxicity.learn(docs, labels))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space runs are one space) the one with the smallest doc_id stays."""
    own = docs.select(F.col("doc_id"), F.col("text"), F.monotonically_increasing_id().alias("_place"))
    found = exact_dedup(own.select(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_place").alias("doc_id"), "text"))
    gone = checkpointed(found.filter(~F.col("kept")).select(F.col("doc_id._place").alias("_place")))
    return without_places(docs, gone)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies stays: similarity 0.8 or more on five-word shingles."""
    return simhash.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by weight, 150 % of all words; a document that is taken twice is there twice."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("mixing", mix_sources), ("packing", pack_sequences)]

#: Learned scores, fingerprints and a tokenizer are beyond SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir. A stage's table goes once the next one is written; the last one stays in the shared folder."""
    import uuid

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
    return docs

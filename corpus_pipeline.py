"""A training corpus from `documents`: quality rules, near duplicates, secrets, mixing, packing.

Each stage works on all that the one before it kept and is written as Parquet between; every decision takes effect on
the rows. All stages but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import mixing, packing, quality, secrets
from quillgraph.llm.common import among, for_texts, table, without
from quillgraph.llm.near_dedup import near_duplicates

#: Near copies share 80 of 100 shingles of five words.
WIDTH, PERCENT = 5, 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail are gone, and so are documents that lose too much or fail the base rules."""
    for_texts(spark)
    return quality.clean_documents(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the smallest id.

    Of rows that repeat an id, and of rows without one, one of each text stays.
    """
    for_texts(spark)
    found = near_duplicates(docs, width=WIDTH, percent=PERCENT)
    gone = table(found.filter(~F.col("kept")).select("doc_id").distinct(), "gone")
    left = without(docs, "doc_id", gone).select(*docs.columns)
    often = table(docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null").select("doc_id"), "often")
    if often.isEmpty():
        return left
    known, named = often.filter("doc_id is not null"), left.filter("doc_id is not null")
    once = without(named, "doc_id", known).unionByName(among(named, "doc_id", known).dropDuplicates(["doc_id", "text"]))
    return once.unionByName(left.filter("doc_id is null").dropDuplicates(["text"])).select(*docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind; every document stays."""
    for_texts(spark)
    return secrets.redact_documents(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens."""
    for_texts(spark)
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("near dedup", dedup_stage),
    ("secret scan", secrets_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL has no tokenizer, and no MinHash or random forest; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

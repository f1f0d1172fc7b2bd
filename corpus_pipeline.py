"""A corpus pipeline over documents: quality rules, toxicity, near duplicates, secret scans, packing.

Each stage gets the session, the documents that the stage before it kept (written as Parquet and read again) and the folder of the tables.
All stages but the last return the columns of documents. Rows whose decisions need a doc_id and have none are kept; null and empty texts go with
the quality rules, as they have too few words; repeated rows stay once; very long texts are read whole by every stage; extra columns of documents
pass through all stages but the last; empty tables give an empty result. Intermediate tables stay under the shared folder until the application releases them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.llm import near_dedup, packing, quality_rules, secrets, toxicity
from veritrail.llm._common import materialize, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current rule policy keeps."""
    kept = quality_rules.ledger(docs).where(quality_rules.keeps())
    return kept.select(*[F.col("record").getField(c).alias(c) for c in docs.columns])


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar, learned from the labels of documents still there, scores below one half."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the least doc_id, once."""
    return near_dedup.distinct_documents(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their secrets masked, n_chars brought up to date."""
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their token ids, packed into sequences."""
    packed = packing.pack(packing.pieces(docs, packing.public_tokenizer()))
    return packed.withColumn("ids_crc32", F.crc32("ids"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("secret_scans", secrets_stage),
    ("best_fit_packing", packing_stage),
]

#: The learned and the hashed stages have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, each result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept;
all but the last return the columns of documents.  ``run`` writes what a stage
returns as Parquet in the shared checkpoint folder and rereads it for the
next, so a lost executor repeats one stage at most.

Repeated rows become one document in the near-duplicate stage; nulls, empty
texts and clashing column names are handled as each operator says.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from causeway.llm import decontam, near_dups, packing, pii, quality
from causeway.llm.common import read
from causeway.session import ensure_checkpoint_dir

#: Similarity of word shingles, in percent, from which documents are near-duplicates.
NEAR_PCT = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and their host's verdict."""
    return quality.quality_stage(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, linked at NEAR_PCT."""
    return near_dups.near_dedup_stage(docs, NEAR_PCT)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.decontaminate_stage(docs, read(spark, sf_dir, "benchmark", "item_id", "text"), short_items=True)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked in the text."""
    return pii.pii_stage(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every document in the training sequences."""
    return packing.pack(docs)


STAGES = [("quality rules", quality_rules), ("near dedup", near_dedup), ("decontamination", decontaminate),
          ("pii", mask_pii), ("packing", pack)]

#: Near-duplicate groups and best-fit bins can't be said in SQL; the tests
#: hold the pipeline against a plain restatement.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs

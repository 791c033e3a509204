"""The corpus pipeline: from raw documents to packed training sequences.

Every stage calls one operator of ``scorekit.llm``, takes the documents its predecessor
kept, and is written as Parquet before the next one reads it.  All but the last return
the columns of ``documents``:

* quality classifier: documents that importance resampling leaves out go;
* exact dedup: of equal texts the smallest doc_id stays;
* near dedup: of documents linked by five-word shingles at a similarity of 0.8 or more,
  the smallest doc_id of each group stays;
* mixing: a row for each copy that the curriculum takes, in training order;
* packing: the pieces of the sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from scorekit.llm.exact_dedup import drop_exact_copies
from scorekit.llm.mixing import take_mix
from scorekit.llm.near_dedup import drop_near_copies
from scorekit.llm.packing import pack_documents
from scorekit.llm.resampling import keep_resampled
from scorekit.session import materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_resampled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_copies(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return take_mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"),
                          public_tokenizers.path("byte_bpe_50k.tiktoken"),
                          public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_dedup_stage),
    ("near dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The stages use models and signatures that SQL does not have.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

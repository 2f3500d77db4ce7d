"""A training corpus from raw documents: five stages, each written as Parquet and reread as the next one's input.

1. ``toxicity`` drops the documents that the classifier calls toxic.
2. ``near_duplicates`` keeps one document of each group of SimHash near-duplicates.
3. ``secrets`` masks secrets in the texts; no document goes.
4. ``mixture`` orders the documents by the target mixture of their sources, across the files it is written to.
5. ``packing`` packs all documents into token sequences, in consecutive runs of the mixture (whose order it derives again from
   the documents, since files have none), and returns one row per piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlight.llm import mixing, packing, pivot_simhash, secret_scan, toxicity
from ledgerlight.llm.staging import stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pivot_simhash.keep_one_per_group(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.in_mixture_order(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_in_order(docs, mixing.order_of(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixture", mix),
    ("packing", pack),
]

#: Training and packing have no SQL form; the tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

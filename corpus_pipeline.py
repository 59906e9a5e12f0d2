"""A training-data pipeline over ``documents``, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next stage's ``docs``. All stages but the last return the columns of ``documents``.

1. quality: documents that the classifier rejects (score under 0.7) go; 2. near copies: one
document of each group of linked documents stays; 3. personal data is replaced by its kind;
4. mixing lays the documents out in the order of the target weights; 5. packing cuts them into
sequences of 2048 tokens, whose ids rise in that order.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txsieve.llm import mixing, ngram_join, packing, pii, quality
from txsieve.llm.common import prepare, table
from txsieve.llm.queries import MIX_WEIGHTS, vocabulary

THRESHOLD = 0.7


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Trains on the labelled rows of ``documents``, and keeps the rows that score 0.7 or more."""
    model = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality", F.lit(True))
    return quality.score(docs, model, THRESHOLD).where("quality_predicted = 1").select(*docs.columns)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.dedupe(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every personal span gives way to <KIND>; n_chars follows."""
    return pii.mask(docs, pii.fit(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, in the order of the mix."""
    return mixing.mixed(docs, MIX_WEIGHTS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, with its sequence and offset; sequence ids rise with the mix."""
    return packing.pack(mixing.laid_out(docs), vocabulary(), order=F.col("mix_position"))


STAGES = [
    ("quality", quality_stage),
    ("near_copies", near_copy_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: No SQL: the stages hold trained models and a tokenizer. tests/llm checks run() in other ways.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written to the shared folder and reread."""
    prepare(spark)
    top = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{name}")
        docs = spark.read.parquet(f"{top}/{name}")
    return docs

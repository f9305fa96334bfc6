"""The corpus pipeline: five operators, each stage written as Parquet and reread by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fillcast.llm.decontamination import without_contaminated
from fillcast.llm.mixing import Mixture, mixed_documents
from fillcast.llm.queries import MIXTURE, domain_of, table
from fillcast.llm.sharding import assign_shards
from fillcast.llm.simhash import without_near_duplicates
from fillcast.llm.toxicity import without_toxic
from fillcast.operators.ordered import ensure_checkpoint_dir

#: Four fifths of the tokens, no document twice: near copies were just removed.
STAGE_MIXTURE = Mixture(weights=MIXTURE.weights, share=0.8, max_epochs=1)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs, [domain_of(), F.col("lang"), F.col("source")], STAGE_MIXTURE)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return assign_shards(docs)


STAGES = [
    ("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination),
    ("mixing", mixing), ("sharding", sharding)]

#: The stages train a model, hash word sequences and follow components, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = f"{base}/{k}-{name}"
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs

"""A training-corpus pipeline: rules, classifier, near-duplicates, mixture and tokens, one operator a stage.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet into the shared
folder and rereads it as the next stage's ``docs``. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from coredust.functions.ship import ship
from coredust.llm import bpe, mixing, quality_net, quality_rules, simhash
from coredust.llm._common import bound_batches, materialize
from coredust.llm.queries import tokenizer_path


def _prepare(spark: SparkSession) -> None:
    ship(spark)
    bound_batches(spark)


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the base rules or the outlier estimate reject."""
    _prepare(spark)
    return quality_rules.keep_good(docs)


def quality_net_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the classifier, trained on the labelled rows of its own input, rejects."""
    _prepare(spark)
    return quality_net.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each near-duplicate group: five-word similarity 0.8 or more."""
    _prepare(spark)
    return simhash.keep_first(docs, budget=simhash.NEAR_BUDGET, similarity=simhash.SIMILARITY)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks, in training order; those beyond the target go."""
    _prepare(spark)
    return mixing.mix(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the encoded and decoded texts, a row for each pass over a document."""
    _prepare(spark)
    return bpe.round_trip_digests(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_net_stage),
    ("simhash_near_dedup", simhash_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: Iterated estimates, a trained network and a tokenizer: not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)



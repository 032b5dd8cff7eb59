"""A training corpus from ``documents``: five stages, each a table that the next one reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm.decontaminate import drop_contaminated
from weftline.llm.exact import drop_exact
from weftline.llm.mixing import mix
from weftline.llm.near import drop_near
from weftline.llm.toxicity import drop_toxic
from weftline.plans.scratch import Scratch, discarded


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier calls toxic."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id."""
    return drop_exact(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8."""
    return drop_near(docs, shingle=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a window of any benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), least_items=1)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of sources, a row for each time a document is taken."""
    return mix(docs)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: The toxicity stage is a trained model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; a stage's input and its own tables are deleted once its output is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch, last = Scratch(spark, "pipeline"), []
    for name, stage in STAGES[:-1]:
        with discarded():
            docs = scratch.keep(stage(spark, docs, sf_dir), name)
        scratch.drop(*last)
        last = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)

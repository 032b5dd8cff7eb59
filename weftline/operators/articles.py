"""Article tables: cascaded first-wins deduplication, bags of entities, postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions import text as X


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order that must be total."""
    return df.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def dedup_cascade(articles: DataFrame, url: str, title: str, order: list[Column], valid: Column) -> DataFrame:
    """Newest article of each URL if it is valid, then the newest of each title.

    A URL is used up by its newest article even if that one isn't valid.
    """
    return first_wins(first_wins(articles, [url], order).where(valid), [title], order)


def entity_bag(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang", "day")) -> DataFrame:
    """Entities of each document with their counts: keep, ne, cnt."""
    words = docs.select(*keep, F.explode(X.entities(F.col("text"))).alias("ne"))
    return words.groupBy(*keep, "ne").agg(F.count(F.lit(1)).alias("cnt"))


def top_entities(df: DataFrame, k: int) -> DataFrame:
    """The k entities with the most documents, ties by name; k rows."""
    return df.groupBy("ne").agg(F.count(F.lit(1)).alias("df")).orderBy(F.desc("df"), "ne").limit(k)

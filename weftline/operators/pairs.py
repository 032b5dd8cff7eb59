"""Candidate pairs through shared entities, and their similarities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.functions.scores import DATE_WINDOW


def shared_entity_pairs(postings: DataFrame, window: int = DATE_WINDOW) -> DataFrame:
    """Distinct unordered pairs (doc1 < doc2) that share an entity within ``window`` days.

    An equi-join on (entity, day bucket): the right side is repeated to the
    buckets next to its own, so a frequent entity is dealt over its days.  The
    bucket of the smaller document is used, so each pair of postings meets once.
    """
    bucket = lambda d: F.floor(d / (window + 1))
    a = postings.select("ne", bucket(F.col("day")).alias("bucket"), F.col("doc_id").alias("doc1"), F.col("day").alias("day1"))
    b = postings.select("ne", F.explode(F.sequence(bucket(F.col("day")) - 1, bucket(F.col("day")) + 1)).alias("bucket"), F.col("doc_id").alias("doc2"), F.col("day").alias("day2"))
    met = a.join(b, ["ne", "bucket"]).where((F.col("doc1") < F.col("doc2")) & (F.abs(F.col("day1") - F.col("day2")) <= window))
    return met.select("doc1", "doc2").distinct()


def entity_sets(bag: DataFrame) -> DataFrame:
    """Each document's entities with counts, as arrays."""
    return bag.groupBy("doc_id", "lang", "day").agg(F.sort_array(F.collect_list(F.struct("ne", "cnt"))).alias("vec")).withColumn("nes", F.col("vec.ne"))


def beside(pairs: DataFrame, docs: DataFrame, columns: list[str], key: str = "doc_id") -> DataFrame:
    """A pair's documents' columns, numbered 1 and 2."""
    for i in (1, 2):
        pairs = pairs.join(docs.select(F.col(key).alias(f"doc{i}"), *(F.col(c).alias(f"{c}{i}") for c in columns)), f"doc{i}")
    return pairs


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def numbered_tokens(docs: DataFrame) -> DataFrame:
    """Each document's tokens numbered by occurrence, so that sets of them count repeats."""
    words = docs.select("doc_id", F.explode(X.tokens(F.col("text"))).alias("w")).groupBy("doc_id", "w").agg(F.count(F.lit(1)).alias("n"))
    each = F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda i: F.concat_ws("\u0001", F.col("w"), i.cast("string")))
    return words.groupBy("doc_id").agg(F.flatten(F.collect_list(each)).alias("occ"))


def weighted_overlap(vec1: Column, vec2: Column) -> Column:
    """Counts of shared entities on both sides over all counts."""
    total = lambda v: F.aggregate(v, F.lit(0).cast("long"), lambda acc, x: acc + x.cnt)
    both = F.array_intersect(vec1.ne, vec2.ne)
    part = lambda v: total(F.filter(v, lambda x: F.array_contains(both, x.ne)))
    return (part(vec1) + part(vec2)) / (total(vec1) + total(vec2))


def dense_cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def top_per(df: DataFrame, key: str, k: int, order: list[Column]) -> DataFrame:
    return df.withColumn("__rn", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("__rn") <= k).drop("__rn")

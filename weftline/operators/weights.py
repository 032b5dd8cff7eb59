"""Term weights: inverse document frequencies, TF-IDF and BM25 of articles and of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def smoothed_idf(bag: DataFrame, articles: DataFrame) -> DataFrame:
    """``ln(N / (1 + df))`` with N all articles."""
    n = articles.agg(F.count(F.lit(1)).alias("n"))
    return bag.groupBy("ne").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).select("ne", "df", F.log(F.col("n") / (1 + F.col("df"))).alias("idf"))  # one row


def collection_idf(bag: DataFrame, kind: str = "classic") -> DataFrame:
    """From collection frequencies: ``log10(S / (cf + 1))`` or BM25's ``log10((S - cf + .5) / (cf + .5))``."""
    s = bag.agg(F.sum("cnt").alias("s"))
    cf = bag.groupBy("ne").agg(F.sum("cnt").alias("cf")).crossJoin(F.broadcast(s))  # one row
    value = F.log10(F.col("s") / (F.col("cf") + 1)) if kind == "classic" else F.log10((F.col("s") - F.col("cf") + 0.5) / (F.col("cf") + 0.5))
    return cf.select("ne", "cf", value.alias("idf"))


def tf_idf(bag: DataFrame, idf: DataFrame, doc: str = "doc_id") -> DataFrame:
    total = F.sum("cnt").over(W.partitionBy(doc))
    return bag.withColumn("total", total).join(idf.select("ne", "idf"), "ne").withColumn("tfidf", F.col("cnt") / F.col("total") * F.col("idf"))


def bm25(bag: DataFrame, idf: DataFrame, doc: str = "doc_id") -> DataFrame:
    """BM25 with relative term frequencies and entity counts as length."""
    sizes = bag.groupBy(doc).agg(F.sum("cnt").alias("total"))
    mean = sizes.agg(F.avg("total").alias("mean"))
    tf = F.col("cnt") / F.col("total")
    rows = bag.join(sizes, doc).join(idf.select("ne", "idf"), "ne").crossJoin(F.broadcast(mean))  # one row
    return rows.withColumn("bm25", F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("total") / F.col("mean"))))


def top_ties(weighted: DataFrame, k: int, value: str = "tfidf", doc: str = "doc_id") -> DataFrame:
    """The k best entities of a document and all that tie with the last of them."""
    return weighted.withColumn("__r", F.rank().over(W.partitionBy(doc).orderBy(F.desc(value)))).where(F.col("__r") <= k).drop("__r")


def shared_weight(pairs: DataFrame, bag: DataFrame, idf: DataFrame, kind: str = "tfidf") -> DataFrame:
    """For each pair (doc1, doc2), the sum over shared entities of the merged article's weights."""
    sizes = bag.groupBy("doc_id").agg(F.sum("cnt").alias("total"))
    one, two = (bag.select(F.col("doc_id").alias(f"doc{i}"), "ne", F.col("cnt").alias(f"cnt{i}")) for i in (1, 2))
    s1, s2 = (sizes.select(F.col("doc_id").alias(f"doc{i}"), F.col("total").alias(f"total{i}")) for i in (1, 2))
    rows = pairs.join(one, "doc1").join(two, ["doc2", "ne"]).join(s1, "doc1").join(s2, "doc2").join(idf.select("ne", "idf"), "ne")
    tf = (F.col("cnt1") + F.col("cnt2")) / (F.col("total1") + F.col("total2"))
    if kind == "bm25":
        rows = rows.crossJoin(F.broadcast(sizes.agg(F.avg("total").alias("mean"))))  # one row
        length = (F.col("total1") + F.col("total2")) / 2 / F.col("mean")
        value = F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length))
    else:
        value = tf * F.col("idf")
    return rows.groupBy("doc1", "doc2").agg(F.sum(value).alias("shared"), F.count(F.lit(1)).alias("n_shared"))

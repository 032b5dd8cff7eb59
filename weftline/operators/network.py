"""Weighted graphs and overlapping clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def undirected(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("c1"), F.greatest(a, b).alias("c2")]


def bilateral(rows: DataFrame, a: str, b: str, value: str, how: str = "sum") -> DataFrame:
    """Values in both directions; of several between two places the sum, or the largest."""
    both = rows.select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(value).alias("v")).union(rows.select(b, a, value))
    return both.groupBy("a", "b").agg((F.sum("v") if how == "sum" else F.max("v")).alias("v"))


def memberships(clusters: DataFrame) -> DataFrame:
    """Each document's clusters as a sorted set."""
    return clusters.groupBy("doc").agg(F.array_sort(F.collect_set("cluster")).alias("clusters"))


def comembership(pairs: DataFrame, clusters: DataFrame) -> DataFrame:
    """How many clusters a pair's documents share, and how many they have together."""
    sets = memberships(clusters)
    for i in (1, 2):
        pairs = pairs.join(sets.select(F.col("doc").alias(f"doc{i}"), F.col("clusters").alias(f"k{i}")), f"doc{i}", "left")
    none = F.array().cast("array<int>")
    k1, k2 = F.coalesce("k1", none), F.coalesce("k2", none)
    return pairs.withColumn("shared", F.size(F.array_intersect(k1, k2))).withColumn("total", F.size(F.array_union(k1, k2))).drop("k1", "k2")


def within_cluster(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """Edges whose documents share a cluster, once for each: cluster, doc1, doc2, weight."""
    one, two = (clusters.select(F.col("doc").alias(f"doc{i}"), F.col("cluster").alias(f"cluster{i}")) for i in (1, 2))
    met = edges.join(one, "doc1").join(two, "doc2").where("cluster1 = cluster2")
    return met.select(F.col("cluster1").alias("cluster"), "doc1", "doc2", "weight")


def modularity(edges: DataFrame, clusters: DataFrame, textbook: bool = False) -> DataFrame:
    """Overlapping modularity over linked pairs.

    ``textbook``: over all pairs of a cluster, linked or not, by sums of
    ``k_i / O_i`` instead of pairs.
    """
    ends = edges.select(F.col("doc1").alias("doc"), "weight").union(edges.select("doc2", "weight"))
    degree = ends.groupBy("doc").agg(F.sum("weight").alias("k"))
    many = clusters.groupBy("doc").agg(F.count(F.lit(1)).alias("o"))
    two_m = edges.agg((2 * F.sum("weight")).alias("m2"))
    node = degree.join(many, "doc")
    one, two = (node.select(F.col("doc").alias(f"doc{i}"), F.col("k").alias(f"k{i}"), F.col("o").alias(f"o{i}")) for i in (1, 2))
    inside = within_cluster(edges, clusters).join(one, "doc1").join(two, "doc2").crossJoin(F.broadcast(two_m))  # one row
    if not textbook:
        return inside.agg(F.sum((F.col("weight") - F.col("k1") * F.col("k2") / F.col("m2")) / (F.col("o1") * F.col("o2")) * 2 / F.col("m2")).alias("q"))
    linked = inside.agg(F.sum(2 * F.col("weight") / (F.col("o1") * F.col("o2"))).alias("a"))
    expected = clusters.join(node, "doc").groupBy("cluster").agg(F.sum(F.col("k") / F.col("o")).alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("e"))
    return linked.crossJoin(expected).crossJoin(two_m).select(((F.col("a") - F.col("e") / F.col("m2")) / F.col("m2")).alias("q"))  # one row each


def partition_density(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    links = within_cluster(edges, clusters).groupBy("cluster").agg(F.count(F.lit(1)).alias("m"))
    part = F.when(F.col("n") > 2, F.col("m") * (F.col("m") - F.col("n") + 1) / ((F.col("n") - 2) * (F.col("n") - 1))).otherwise(0.0)
    return sizes.join(links, "cluster").agg((2 / F.sum("m") * F.sum(part)).alias("d"))


def distribution(rows: DataFrame, group: str, key: str, least: int = 1) -> DataFrame:
    """Shares of keys in each group, over keys with at least ``least`` rows."""
    counts = rows.groupBy(group, key).agg(F.count(F.lit(1)).alias("n"))
    big = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least).select(key)
    kept = counts.join(big, key, "left_semi")
    return kept.withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy(group)))


def strengths(edges: DataFrame) -> DataFrame:
    """Number of links and sum of weights of each node."""
    ends = edges.select(F.col("c1").alias("c"), "weight").union(edges.select("c2", "weight"))
    return ends.groupBy("c").agg(F.count(F.lit(1)).alias("k"), F.sum("weight").alias("s"))


def backbone(edges: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Disparity filter: links that are unlikely for at least one of their ends."""
    node = strengths(edges)
    for i in (1, 2):
        edges = edges.join(node.select(F.col("c").alias(f"c{i}"), F.col("k").alias(f"k{i}"), F.col("s").alias(f"s{i}")), f"c{i}")
    a = [F.when(F.col(f"k{i}") > 1, F.pow(1 - F.col("weight") / F.col(f"s{i}"), F.col(f"k{i}") - 1)).otherwise(1.0) for i in (1, 2)]
    return edges.withColumn("alpha", F.least(*a)).where(F.col("alpha") < alpha)


def page_rank(edges: DataFrame, rounds: int, damping: float = 0.85) -> DataFrame:
    """Weighted PageRank of an undirected graph: one join and one aggregation a round."""
    both = edges.select("c1", "c2", "weight").union(edges.select("c2", "c1", "weight")).toDF("a", "b", "weight")
    share = both.withColumn("share", F.col("weight") / F.sum("weight").over(W.partitionBy("a"))).select("a", "b", "share")
    nodes = both.select(F.col("a").alias("c")).distinct()
    n = nodes.agg(F.count(F.lit(1)).alias("n"))
    rank = nodes.crossJoin(F.broadcast(n)).select("c", "n", (1 / F.col("n")).alias("r"))  # one row
    for _ in range(rounds):
        got = share.join(rank.select(F.col("c").alias("a"), "r", "n"), "a")
        rank = got.groupBy(F.col("b").alias("c")).agg(F.first("n").alias("n"), F.sum(F.col("r") * F.col("share")).alias("x")).select("c", "n", ((1 - damping) / F.col("n") + damping * F.col("x")).alias("r"))
    return rank.select("c", "r")


def label_propagation(edges: DataFrame, rounds: int = 3) -> DataFrame:
    """Communities: each node takes its neighbours' heaviest label, the least of equals."""
    both = edges.select("c1", "c2", "weight").union(edges.select("c2", "c1", "weight")).toDF("a", "b", "weight")
    label = both.select("a").distinct().withColumn("l", F.col("a"))
    for _ in range(rounds):
        votes = both.join(label.withColumnRenamed("a", "b"), "b").groupBy("a", "l").agg(F.sum("weight").alias("w"))
        label = votes.groupBy("a").agg(F.max(F.struct(F.round("w", 6).alias("w"), (-F.col("l")).alias("l"))).alias("x")).select("a", (-F.col("x.l")).alias("l"))
    return label.toDF("c", "community")

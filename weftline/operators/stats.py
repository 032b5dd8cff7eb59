"""Grouped statistics of similarities."""

from __future__ import annotations

import functools
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.plans.scratch import Scratch


def group_stats(df: DataFrame, keys: list[str], value: str = "sim") -> DataFrame:
    """Mean, count and standard error of the mean."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count(value).alias("n"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("sem"))


def t_tail(t: float, df: float) -> float:
    """The upper tail of Student's t, by the incomplete beta function's continued fraction."""
    a, b, x = df / 2, 0.5, df / (df + t * t)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    flip = x >= (a + 1) / (a + b + 2)
    if flip:
        a, b, x = b, a, 1 - x
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + num * d), 1 + num / c
            h *= d * c
    value = front * h / a
    return (1 - value if flip else value) / 2


@functools.lru_cache(maxsize=4096)
def _quantile(df: int, p: float) -> float:
    """Student's t quantile by bisection on the tail."""
    lo, hi = 0.0, 1e3
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_tail(mid, df) > 1 - p else (lo, mid)
    return hi


def with_p_value(rows: DataFrame, r: str = "r", n: str = "n") -> DataFrame:
    """Add ``p``, the two-sided p value of a correlation of ``n`` pairs; null for fewer than three."""
    t = F.abs(r) * F.sqrt((F.col(n) - 2) / F.nullif(1 - F.col(r) * F.col(r), F.lit(0.0)))

    @F.pandas_udf("double")  # a row for each group
    def two_sided(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([2 * t_tail(x, k - 2) if k > 2 and not math.isnan(x) else None for x, k in zip(t, n, strict=True)], dtype="float64")

    exact = F.abs(r) >= 1  # t is null
    return rows.withColumn("p", F.when(F.col(n) > 2, F.when(exact, 0.0).otherwise(two_sided(t, F.col(n).cast("double")))))


def t_quantiles(spark: SparkSession, most: int = 200, p: float = 0.975) -> DataFrame:
    """Student's t quantiles for 1 to ``most`` degrees of freedom."""
    return spark.createDataFrame([(i, _quantile(i, p)) for i in range(1, most + 1)], "df int, t double")


def late_quantile(df: Column) -> Column:
    """Student's t quantile at 0.975 for many degrees of freedom: a series in 1/df, to about 1e-10 from 100 on."""
    z = 1.959963984540054
    terms = (z, (z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384, (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160)
    return sum((F.lit(c) / F.pow(df, F.lit(i)) for i, c in enumerate(terms[1:], 1)), F.lit(terms[0]))


def with_interval(stats: DataFrame, most: int = 200) -> DataFrame:
    """Add the half width of the 95 % t interval at n - 1; beyond the table, its quantile is a series."""
    t = t_quantiles(stats.sparkSession, most)
    rows = stats.withColumn("df", F.col("n") - 1).join(F.broadcast(t), "df", "left")
    return rows.withColumn("ci95", F.col("sem") * F.when(F.col("df") > most, late_quantile(F.col("df"))).otherwise(F.col("t"))).drop("df", "t")


def pair_population(counts: DataFrame, n: str = "n") -> DataFrame:
    """Possible pairs inside countries and between them, from article counts."""
    return counts.agg(F.sum(F.col(n) * (F.col(n) - 1)).cast("long").alias("intra"), ((F.pow(F.sum(n), 2) - F.sum(F.col(n) * F.col(n))) / 2).cast("long").alias("inter"))


def average_ranks(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Add the mean rank of equal values inside each group, ranked over distinct values.

    Without groups, values are dealt out by range, and a range's ranks start
    after the rows of those before it, so no task sorts all values.
    """
    if not by:
        scratch = Scratch(df.sparkSession, "ranks")
        sizes = df.groupBy(value).agg(F.count(F.lit(1)).alias("__n")).repartitionByRange(value).withColumn("__part", F.spark_partition_id())
        sizes = scratch.keep(sizes, "sizes")
        before = F.sum("__m").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1))  # a row for each partition
        parts = sizes.groupBy("__part").agg(F.sum("__n").alias("__m")).select("__part", F.coalesce(before, F.lit(0)).alias("__base"))
        below = F.sum("__n").over(W.partitionBy("__part").orderBy(value).rowsBetween(W.unboundedPreceding, -1))
        ranks = sizes.join(F.broadcast(parts), "__part").select(value, (F.col("__base") + F.coalesce(below, F.lit(0)) + (F.col("__n") + 1) / 2).alias(f"{value}_rank"))
        return df.join(ranks, value)
    sizes = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    below = F.sum("__n").over(W.partitionBy(*by).orderBy(value).rowsBetween(W.unboundedPreceding, -1))
    ranks = sizes.withColumn(f"{value}_rank", F.coalesce(below, F.lit(0)) + (F.col("__n") + 1) / 2).drop("__n")
    return df.join(ranks, [*by, value])


def superiority(df: DataFrame, by: list[str], group: str, value: str) -> DataFrame:
    """P(value of group 1 > value of group 0) + half of ties, exactly, by the rank sum."""
    ranked = average_ranks(df, value, by)
    n1, n0 = F.sum((F.col(group) == 1).cast("long")), F.sum((F.col(group) == 0).cast("long"))
    r1 = F.sum(F.when(F.col(group) == 1, F.col(f"{value}_rank")))
    return ranked.groupBy(*by).agg(n1.alias("n1"), n0.alias("n0"), ((r1 - n1 * (n1 + 1) / 2) / (n1 * n0)).alias("p")).where("n1 > 0 AND n0 > 0")


def leave_one_out(df: DataFrame, by: list[str], member: str, value: str) -> DataFrame:
    """The mean of each group without each of its members."""
    own = df.groupBy(*by, member).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    w = W.partitionBy(*by)
    s, n = F.sum("s").over(w), F.sum("n").over(w)
    return own.select(*by, member, ((s - F.col("s")) / F.nullif(n - F.col("n"), F.lit(0))).alias("mean"))


def entropy_similarity(p: Column, k: Column) -> Column:
    """``1 - H(p) / ln k`` as an aggregate over a distribution's shares."""
    return 1 + F.sum(F.when(p > 0, p * F.log(p)).otherwise(0.0)) / F.log(k)


def js_similarity(dist: DataFrame, a: str = "country", key: str = "cluster", p: str = "p") -> DataFrame:
    """``1 - sqrt(JS divergence)`` of each pair of distributions, over their keys.

    With M the mean, the divergence is ``1 + sum over shared keys`` in a form that
    needs the shared keys only: absent ones give ``p ln 2 / 2`` each.
    """
    x, y = (dist.select(F.col(a).alias(f"{a}{i}"), key, F.col(p).alias(f"p{i}")) for i in (1, 2))
    met = x.join(y, key).where(F.col(f"{a}1") < F.col(f"{a}2"))
    m = (F.col("p1") + F.col("p2")) / 2
    term = lambda q: F.when(q > 0, q * F.log(q / m)).otherwise(0.0)
    shared = met.groupBy(f"{a}1", f"{a}2").agg((F.sum(term(F.col("p1")) + term(F.col("p2"))) / 2).alias("d"), F.sum("p1").alias("s1"), F.sum("p2").alias("s2"))
    names = dist.select(a).distinct()
    every = names.select(F.col(a).alias(f"{a}1")).join(F.broadcast(names.select(F.col(a).alias(f"{a}2"))), F.col(f"{a}1") < F.col(f"{a}2"))  # countries: a few hundred
    out = every.join(shared, [f"{a}1", f"{a}2"], "left")
    absent = (2 - F.coalesce("s1", F.lit(0.0)) - F.coalesce("s2", F.lit(0.0))) / 2 * math.log(2)
    return out.select(f"{a}1", f"{a}2", (1 - F.sqrt(F.greatest(F.lit(0.0), F.coalesce("d", F.lit(0.0)) + absent))).alias("sim"))


def min_max(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns scaled to [0, 1]; a constant column becomes 0."""
    limits = df.agg(*(f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))))
    out = df.crossJoin(F.broadcast(limits))  # one row
    scaled = {c: F.coalesce((F.col(c) - F.col(f"__lo_{c}")) / F.nullif(F.col(f"__hi_{c}") - F.col(f"__lo_{c}"), F.lit(0)), F.lit(0.0)) for c in columns}
    return out.withColumns(scaled).select(*df.columns)


def varying(df: DataFrame, columns: list[str]) -> list[str]:
    """The columns with more than one distinct value."""
    row = df.agg(*(F.count_distinct(c).alias(c) for c in columns)).first()
    return [c for c in columns if row[c] > 1]


def binary_metrics(df: DataFrame, label: str, predicted: str, score: str) -> DataFrame:
    """Precision, recall, F1, accuracy, Matthews' correlation and AUC (exact, by rank sum)."""
    c = {n: F.sum(((F.col(label) == a) & (F.col(predicted) == b)).cast("double")) for n, a, b in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0))}
    cells = df.agg(*(v.alias(k) for k, v in c.items()))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    out = cells.select(
        (tp / F.nullif(tp + fp, F.lit(0))).alias("precision"), (tp / F.nullif(tp + fn, F.lit(0))).alias("recall"),
        (2 * tp / F.nullif(2 * tp + fp + fn, F.lit(0))).alias("f1"), ((tp + tn) / (tp + fp + fn + tn)).alias("accuracy"),
        ((tp * tn - fp * fn) / F.nullif(F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), F.lit(0))).alias("mcc"),
    )
    auc = superiority(df, [], label, score).select(F.col("p").alias("auc"))
    return out.crossJoin(auc)  # one row each


def agreement(n: Column, observed: Column, a: Column, b: Column) -> dict[str, Column]:
    """Agreement of two raters of ``n`` items over two classes, corrected for chance in five ways.

    ``observed``: the share of items on which they agree; ``a``, ``b``: each one's share of the first class.
    """
    m = (a + b) / 2
    corrected = lambda chance: (observed - chance) / F.nullif(1 - chance, F.lit(0.0))
    unlike = 2 * m * (1 - m)
    return {
        "agreement": observed, "cohen": corrected(a * b + (1 - a) * (1 - b)), "scott": corrected(m * m + (1 - m) * (1 - m)), "gwet": corrected(unlike), "bennett": corrected(F.lit(0.5)),
        "krippendorff": 1 - (1 - observed) * (2 * n - 1) / (2 * n) / F.nullif(unlike, F.lit(0.0)),
    }

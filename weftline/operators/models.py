"""Regressions and classifiers with MLlib."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assembled(df: DataFrame, features: list[str], label: str) -> DataFrame:
    rows = df.select(*(F.col(c).cast("double") for c in features), F.col(label).cast("double").alias("label")).dropna()
    return VectorAssembler(inputCols=features, outputCol="features").transform(rows)


def ols(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Coefficients with p values, and the fit's R2, adjusted R2 and AIC: one row per term."""
    fit = LinearRegression(solver="normal").fit(assembled(df, features, label))
    s = fit.summary
    terms = zip([*features, "intercept"], [*map(float, fit.coefficients), float(fit.intercept)], map(float, s.pValues), strict=True)
    n, k = int(s.numInstances), len(features) + 1
    aic = n * math.log(2 * math.pi * s.meanSquaredError) + n + 2 * k
    return df.sparkSession.createDataFrame([(*t, float(s.r2), float(s.r2adj), aic, n) for t in terms], "term string, coefficient double, p double, r2 double, r2_adjusted double, aic double, n long")


def gram(df: DataFrame, features: list[str], label: str) -> tuple[np.ndarray, int]:
    """The cross products of (1, features, label) in one aggregation: a matrix of the columns' number."""
    names = [*features, label]
    cols = [F.lit(1.0), *(F.col(c).cast("double") for c in names)]
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    row = df.dropna(subset=names).agg(*(F.sum(cols[i] * cols[j]).alias(f"g{i}_{j}") for i, j in pairs)).first()
    g = np.zeros((len(cols), len(cols)))
    for (i, j), v in zip(pairs, row, strict=True):
        g[i, j] = g[j, i] = v or 0.0
    return g, int(g[0, 0])


def _rss(g: np.ndarray, chosen: list[int], target: int) -> float:
    at = [0, *chosen]
    a, b = g[np.ix_(at, at)], g[at, target]
    return float(g[target, target] - b @ np.linalg.lstsq(a, b, rcond=None)[0])


def select_features(df: DataFrame, features: list[str], label: str, most_vif: float = 5.0) -> tuple[list[str], list[float]]:
    """Greedy forward selection by AIC among features whose variance inflation stays low.

    All steps work on the matrix of cross products, so the rows are read once.
    """
    g, n = gram(df, features, label)
    target = len(features) + 1
    low: list[int] = []
    for i in range(1, target):
        total = g[i, i] - g[0, i] ** 2 / max(n, 1)
        rest = _rss(g, low, i)
        if total > 1e-9 and rest > 1e-9 and total / rest <= most_vif:
            low.append(i)
    aic = lambda s: n * np.log(max(_rss(g, s, target), 1e-12) / n) + 2 * (len(s) + 1)
    chosen: list[int] = []
    path = [aic(chosen)]
    while rest_ := [i for i in low if i not in chosen]:
        best = min(rest_, key=lambda i: aic([*chosen, i]))
        if aic([*chosen, best]) >= path[-1] - 1e-9:
            break
        chosen.append(best)
        path.append(aic(chosen))
    return [features[i - 1] for i in chosen], path


def importances(df: DataFrame, features: list[str], label: str, trees: int = 20) -> DataFrame:
    fit = GBTRegressor(maxIter=trees, maxDepth=3, seed=7).fit(assembled(df, features, label))
    return df.sparkSession.createDataFrame([(f, float(v)) for f, v in zip(features, fit.featureImportances.toArray(), strict=True)], "feature string, importance double")


def balanced_logistic(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Labels, predictions and scores of a logistic regression with balanced class weights."""
    rows = assembled(df, features, label)
    n = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}  # two classes
    weight = F.when(F.col("label") == 1, sum(n.values()) / (2.0 * max(n.get(1.0, 1), 1))).otherwise(sum(n.values()) / (2.0 * max(n.get(0.0, 1), 1)))
    rows = rows.withColumn("w", weight)
    from pyspark.ml.functions import vector_to_array

    return LogisticRegression(weightCol="w").fit(rows).transform(rows).select("label", "prediction", vector_to_array("probability")[1].alias("score"))


def linear_svc(df: DataFrame, features: list[str], label: str) -> DataFrame:
    rows = assembled(df, features, label)
    return OneVsRest(classifier=LinearSVC(maxIter=20)).fit(rows).transform(rows).select("label", "prediction")

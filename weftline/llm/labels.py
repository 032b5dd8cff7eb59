"""A bounded, deterministic sample of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remainder(id_col: str, n: int):
    """crc32 of an id's decimal text modulo ``n``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def training_ids(labels: DataFrame, label: str, allowed, most: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``most // 2`` ids of either label, by the least hash: ``(id, label)``.

    Rows with a null id or label are left out; an id with several rows counts
    once and needs them to agree.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull()).where(allowed)
    one = known.groupBy(id_col).agg(F.min(label).alias("__a"), F.max(label).alias("__b")).where("__a = __b")
    one = one.select(F.col(id_col).alias("__id"), (F.col("__a") > 0).cast("int").alias("__label"))
    order = [F.xxhash64("__id"), F.col("__id")]
    parts = [one.where(F.col("__label") == v).orderBy(*order).limit(most // 2) for v in (0, 1)]
    return parts[0].unionByName(parts[1])


def label_counts(labels: DataFrame, label: str, allowed, id_col: str = "doc_id") -> tuple[int, int]:
    """Rows of label 0 and of label 1 among all that are allowed."""
    row = labels.where(allowed).agg(F.sum((F.col(label) <= 0).cast("long")), F.sum((F.col(label) > 0).cast("long"))).first()
    return row[0] or 0, row[1] or 0

"""Exact duplicates by progressive refinement, with DataFrame functions only.

Rows are grouped by length, what is left by length and the hash of a prefix,
and only the rows of groups that survive both are read in full and grouped by a
SHA-256 of their whole content.  The first two groupings are partial
aggregations to one row per key, so one text that holds a third of all rows
costs one row per task.  Survivors are told from the rest by bitmaps of bounded
size, so the others' texts are neither hashed nor moved.

Defined results: a null text counts as empty; a null id never outranks another
id (a group of null ids only keeps those); other columns are ignored when texts
are compared.  ``mark_exact`` marks rows that repeat both id and text alike;
``drop_exact`` keeps one of them, an empty text before a null one, then that
with the largest other columns (maps aren't compared).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.plans.pruning import among, quoted, unused
from weftline.plans.scratch import Scratch

PREFIX = 64


def survivors(docs: DataFrame, text_col: str, scratch: Scratch, prefix: int = PREFIX) -> tuple[DataFrame, DataFrame]:
    """Rows whose length and prefix hash another row may have, and the other rows."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    length = F.octet_length(text).cast("long")
    head = F.xxhash64(F.substring(text, 1, prefix))
    rows = docs.select(length.alias("length"), head.alias("head"))
    by_length = scratch.keep(rows.groupBy("length").count().where("count > 1").select("length"), "lengths")
    by_head = scratch.keep(
        rows.join(by_length, "length", "left_semi").groupBy("length", "head").count().where("count > 1").select("length", "head"),
        "heads",
    )
    return among(docs, [length, head], by_head, scratch)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX) -> DataFrame:
    """Groups of two or more equal texts: sha256, keep_id (largest id), group_size."""
    scratch = Scratch(docs.sparkSession, "exact")
    may, _ = survivors(docs.select(id_col, text_col), text_col, scratch, prefix)
    # The survivors' whole content is hashed by the scan; only its digest travels.
    full = may.select(F.col(id_col).alias("id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("sha256"))
    return scratch.keep(full.groupBy("sha256").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1"), "groups")


def mark_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    groups = exact_groups(docs, id_col, text_col)
    digest = docs.select(F.col(id_col), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("text_sha256"))
    same = groups.select(F.col("sha256").alias("text_sha256"), "keep_id", "group_size")
    return digest.join(same, "text_sha256", "left").select(
        id_col,
        F.when(F.col("group_size").isNull(), F.col(id_col)).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("group_size").isNull(), True).otherwise(F.col(id_col).eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


def _ordered(kind: str) -> bool:
    """Whether values of a type can be compared."""
    return not any(x in kind for x in ("map<", "variant", "interval"))


def one_of(rows: DataFrame, keys: list[str], first: list[str], apart: list[str] | None = None) -> DataFrame:
    """One row of each group: that with the largest ``first``, then the largest other columns but ``apart``.

    A partial aggregation, so that each task sends one row of a group.
    """
    rest = [c for c, kind in rows.dtypes if c not in first and c not in keys and c not in (apart or ()) and _ordered(kind)]
    whole = unused("__row", rows)
    best = F.max_by(F.struct(*quoted(*rows.columns)), F.struct(F.lit(0), *quoted(*first, *rest))).alias(whole)
    return rows.groupBy(*quoted(*keys)).agg(best).select(f"{whole}.*")


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each text: that with the largest id, of equal ids the one with the largest other columns."""
    scratch = Scratch(docs.sparkSession, "exact")
    may, others = survivors(docs, text_col, scratch)
    sha, there = unused("__sha", docs), unused("__there", docs)
    named = may.withColumns({sha: F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256), there: F.col(text_col).isNotNull()})
    return others.unionByName(one_of(named, [sha], [id_col, there], [text_col]).drop(sha, there))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_exact(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op7_exact_dedup": op7_exact_dedup}
ORACLE_SQL = {
    "op7_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY t) AS keep_id,
               count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept,
               sha256(t) AS text_sha256
        FROM d
    """
}

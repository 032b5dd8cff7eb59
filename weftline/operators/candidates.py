"""Candidate pairs from whole entity sets, and the refinement of candidates."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.functions.scores import DATE_WINDOW
from weftline.operators import meeting as M
from weftline.operators.pairs import beside
from weftline.operators.together import together
from weftline.plans.scratch import Scratch


def similar_pairs(bag: DataFrame, least: float, scratch: Scratch, *, same_language: bool, window: int = DATE_WINDOW) -> DataFrame:
    """Pairs (doc1 < doc2) within ``window`` days whose entity sets have a Jaccard similarity of ``least`` or more.

    A prefix join: with the entities of all documents in one order, rarest
    first, two sets that are similar enough share one of the first
    ``n - ceil(least * n) + 1`` of each.  So documents meet at these only, and
    frequent entities are hardly ever among them.  Where two meet, bounds on
    what they can share and then all their entities are looked at, and nothing
    is shuffled any more.  Columns: doc1, doc2, n1, n2, both, jaccard.
    """
    return alike(M.vectors(bag, bag, scratch), least, M.Meeting(window), scratch, same_language=same_language)


def alike(docs: DataFrame, least: float, of: M.Meeting, scratch: Scratch, *, same_language: bool) -> DataFrame:
    """``similar_pairs`` of documents' vectors, with the sums and columns that ``of`` asks for."""
    limits = {"same": least} if same_language else {"other": least}
    found = M.met(docs, M.prefix(least), replace(of, alike=True, whole=True, beside=("n", *of.beside), **limits), scratch)
    return found.withColumn("jaccard", F.col("both") / (F.col("n1") + F.col("n2") - F.col("both")))


def text_alike(pairs: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Add ``alike``, the Jaccard similarity of the texts' tokens with their counts; ``pairs`` is a kept table."""
    rows = together(pairs, docs, scratch)
    return rows.select(*pairs.columns, (F.col("common") / (F.col("size1") + F.col("size2") - F.col("common"))).alias("alike"))


def best_candidates(found: DataFrame, k: int) -> DataFrame:
    """For each document its ``k`` most similar candidates, both ways: doc, other, jaccard, rank; the least id first of equals."""
    ways = found.select(F.col("doc1").alias("doc"), F.col("doc2").alias("other"), "jaccard").union(found.select("doc2", "doc1", "jaccard"))
    rank = F.row_number().over(W.partitionBy("doc").orderBy(F.desc("jaccard"), "other"))
    return ways.withColumn("rank", rank).where(F.col("rank") <= k)


def judged(pairs: DataFrame, docs: DataFrame, shared: DataFrame | None, scratch: Scratch, *, min_shared: int = 5, min_weight: float = 1.25, most_alike: float = 0.25) -> DataFrame:
    """Each candidate with the refinement's conditions: enough, weighty, long, dup, and kept.

    ``pairs``: doc1, doc2, lang1, lang2, both (shared entities), a kept table;
    ``shared``: doc1, doc2, shared (summed weights of shared entities), or None if the pairs have it.
    Duplicates are pairs of one language with a long sentence in common and
    texts that are alike by counts of tokens.
    """
    same = F.col("lang1") == F.col("lang2")
    sizes = docs.select("doc_id", F.size(X.tokens(F.col("text"))).alias("size"))
    own = scratch.keep(pairs.where(same), "same")
    text = F.col("common") / (F.col("size1") + F.col("size2") - F.col("common"))
    dup = together(own, docs, scratch, sentences=True).where(F.col("sentence") & (text > most_alike)).select("doc1", "doc2", F.lit(True).alias("dup"))
    rows = beside(pairs if shared is None else pairs.join(shared, ["doc1", "doc2"], "left"), sizes, ["size"]).join(dup, ["doc1", "doc2"], "left")
    flags: dict[str, Column] = {
        "enough": F.col("both") >= min_shared,
        "weighty": F.coalesce(F.col("shared"), F.lit(0.0)) >= min_weight,
        "long": (F.col("size1") >= X.MIN_TOKENS) & (F.col("size2") >= X.MIN_TOKENS),
        "dup": F.coalesce("dup", F.lit(False)),
    }
    kept = F.col("enough") & F.col("weighty") & F.col("long") & ~F.col("dup")
    return rows.withColumns(flags).withColumn("kept", kept).select(*(c for c in pairs.columns if c != "shared"), "shared", *flags, "kept")

"""Candidates from whole entity sets within the date window, refined."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import candidates as C
from weftline.operators import meeting as M
from weftline.plans.scratch import Scratch
from weftline.queries.linking import BAG, MULTI, SHARED, bag, docs, r6
from weftline.queries.scalars import TOKENS
from weftline.registry import query

#: From the definition: all pairs of documents in the window, and what their whole sets share.
WINDOW = f"""{BAG}, n AS (SELECT doc_id, lang, day, count(*) AS n FROM bag GROUP BY ALL),
    shares AS (SELECT a.doc_id AS doc1, b.doc_id AS doc2, count(*) AS both_ FROM bag a JOIN bag b ON a.ne = b.ne AND a.doc_id < b.doc_id GROUP BY ALL),
    every AS (SELECT x.doc_id AS doc1, y.doc_id AS doc2, x.lang AS lang1, y.lang AS lang2, coalesce(both_, 0) AS both_, coalesce(both_, 0) / (x.n + y.n - coalesce(both_, 0)) AS jac
              FROM n x JOIN n y ON x.doc_id < y.doc_id AND abs(x.day - y.day) <= 5 LEFT JOIN shares s ON s.doc1 = x.doc_id AND s.doc2 = y.doc_id),
    intra AS (SELECT * FROM every WHERE lang1 = lang2 AND jac >= 0.3), inter AS (SELECT * FROM every WHERE lang1 <> lang2 AND jac >= 0.2)"""
RANKED = f"{WINDOW}, ranked AS (SELECT doc, other, jac, row_number() OVER (PARTITION BY doc ORDER BY jac DESC, other)::INT AS rank FROM (SELECT doc1 AS doc, doc2 AS other, jac FROM intra UNION ALL SELECT doc2, doc1, jac FROM intra))"


def found(spark, sf, same_language):
    scratch = Scratch(spark, "candidates")
    entities = scratch.keep(bag(spark, sf), "bag")
    return C.similar_pairs(entities, 0.3 if same_language else 0.2, scratch, same_language=same_language)


@query("q_window_intra", f"WITH {WINDOW} SELECT doc1, doc2, both_ AS n_shared, round(jac, 6) AS jaccard FROM intra")
def window_intra(spark, sf):
    return found(spark, sf, True).select("doc1", "doc2", F.col("both").alias("n_shared"), r6(F.col("jaccard"), "jaccard"))


@query("q_window_inter", f"WITH {WINDOW} SELECT doc1, doc2, both_ AS n_shared, round(jac, 6) AS jaccard FROM inter")
def window_inter(spark, sf):
    return found(spark, sf, False).select("doc1", "doc2", F.col("both").alias("n_shared"), r6(F.col("jaccard"), "jaccard"))


@query("q_window_topk", f"WITH {RANKED} SELECT doc, other, rank FROM ranked WHERE rank <= 50")
def window_topk(spark, sf):
    return C.best_candidates(found(spark, sf, True), 50).select("doc", "other", "rank")


@query("q_window_best", f"WITH {RANKED} SELECT doc, other FROM ranked WHERE rank = 1")
def window_best(spark, sf):
    return C.best_candidates(found(spark, sf, True), 1).select("doc", "other")


REPORT = rf"""{WINDOW}, {MULTI}, both_kinds AS (SELECT * FROM intra UNION ALL SELECT * FROM inter), pairs AS (SELECT doc1, doc2 FROM both_kinds),
    idf AS (SELECT ne, ln((SELECT count(*) FROM documents) / (1 + count(*))) AS idf FROM bag GROUP BY ne), t AS (SELECT doc_id, sum(cnt) AS total FROM bag GROUP BY doc_id),
    sh AS (SELECT doc1, doc2, sum(tf * idf) AS shared FROM ({SHARED}) GROUP BY ALL),
    m AS (SELECT doc1, doc2, sum(least(a.c, b.c)) AS common FROM pairs JOIN tc a ON a.doc_id = doc1 JOIN tc b ON b.doc_id = doc2 AND a.w = b.w GROUP BY ALL),
    st AS (SELECT doc_id, len({TOKENS}) AS size, list_distinct(list_transform(list_filter(string_split(text, '.'), lambda s: length(s) > 40), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g'))) AS st FROM documents),
    flags AS (SELECT doc1, doc2, shared, both_ >= 5 AS enough, coalesce(shared, 0) >= 1.25 AS weighty, x.size >= 100 AND y.size >= 100 AS long,
              lang1 = lang2 AND list_has_any(x.st, y.st) AND coalesce(common, 0) / (x.size + y.size - coalesce(common, 0)) > 0.25 AS dup
              FROM both_kinds LEFT JOIN sh USING (doc1, doc2) LEFT JOIN m USING (doc1, doc2) JOIN st x ON x.doc_id = doc1 JOIN st y ON y.doc_id = doc2)"""


def report(spark, sf):
    scratch = Scratch(spark, "refined")
    d = docs(spark, sf)
    own = M.vectors(scratch.keep(bag(spark, sf), "bag"), d, scratch)
    of = M.weighed(M.Meeting(sums=("tfidf",), beside=("lang",), place=True), own, d)
    rows = []
    for least, same in ((0.3, True), (0.2, False)):
        found = C.alike(own, least, of, scratch, same_language=same)
        rows.append(scratch.keep(found.select("doc1", "doc2", "lang1", "lang2", "both", F.col("tfidf").alias("shared"), *M.PLACE), "pairs"))
        del found
        scratch.settle()
    pairs = rows[0].unionByName(rows[1])
    return C.judged(pairs, d, None, scratch)


@query("q_refine_report", f"WITH {REPORT} SELECT doc1, doc2, round(shared, 5) AS shared, enough, weighty, long, dup, enough AND weighty AND long AND NOT dup AS kept FROM flags")
def refine_report(spark, sf):
    """Every candidate with the outcome of each condition of the refinement."""
    return report(spark, sf).select("doc1", "doc2", F.round("shared", 5).alias("shared"), "enough", "weighty", "long", "dup", "kept")


@query("q_duplicate_log", f"WITH {REPORT} SELECT doc1, doc2 FROM flags WHERE enough AND weighty AND long AND dup")
def duplicate_log(spark, sf):
    """Candidates that pass every other condition and are dropped as duplicates."""
    return report(spark, sf).where("enough AND weighty AND long AND dup").select("doc1", "doc2")

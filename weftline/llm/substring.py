"""Removal of repeated passages by recompression.

1. Each document is parsed into symbols (see recompress).  A window's anchor is
   one of the symbols that depend on words inside it only, chosen by these
   symbols alone, so copies of a window have the same anchor; one aggregation
   over all anchor names finds those that occur once in the corpus, with their
   place.
2. A window whose anchor occurs once has no copy.  All other windows are
   candidates: the shared anchors reveal them, and windows without an anchor
   are always among them, so no repeat is lost.
3. A second aggregation over BLAKE2 digests of the candidate windows' words
   verifies them: a candidate that occurs once is struck out, again with its
   place.  Word hashes and symbols only say what to look at; words or symbols
   that share a hash by chance make more candidates and change nothing.
4. What is left of the candidates repeats, and its words are removed.

Both aggregations combine on the map side and keep only what occurs once, so a
passage that a third of all documents share is a row per task, and nothing is
joined back by content.  A place is a row's id and one number of its text's
hash and the place in it: what is moved most has few and short columns, and the
greatest place of one row is its own.  Documents are joined with their own lists by row key.

Defined results: null and blank texts have no words; texts shorter than the
window keep all words; rows that repeat id and text are occurrences of their
own, so their windows repeat; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import recompress as rc
from weftline.llm import wordhash as wh
from weftline.plans.scratch import Scratch

WINDOW = 35
ROUNDS = 6
LONGEST = 12


def window_digests(batch: wh.Batch, at: np.ndarray, window: int) -> list[np.ndarray]:
    """128-bit digests of the windows' words, joined by one space, as two numbers."""
    size = batch.end - batch.start
    start = np.cumsum(size + 1) - size - 1  # in the joined words
    joined = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
    joined[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = batch.data[wh.RAW.is_word[batch.data]]
    text, blake = memoryview(joined.tobytes()), hashlib.blake2b
    last = at + window - 1
    found = b"".join([blake(text[a:b], digest_size=16).digest() for a, b in zip(start[at].tolist(), (start + size)[last].tolist(), strict=True)])
    halves = np.frombuffer(found, np.int64).reshape(-1, 2)
    return [halves[:, 0], halves[:, 1]]

def _parsed(rb: pa.RecordBatch, window: int, rounds: int, longest: int, bits: int):
    batch = wh.split(rb.column(2), wh.RAW)
    if bits < 64:
        batch.hash = batch.hash >> np.uint64(64 - bits)
    symbols = rc.parse(batch.hash, batch.first, rounds, longest)
    at = np.searchsorted(symbols.start, batch.first)  # each document's first symbol
    return batch, symbols, at

def _ints(col: pa.Array, i: int) -> np.ndarray:
    value = col[i].as_py()
    return np.zeros(0, np.int64) if value is None else np.asarray(value, np.int64)

def _places(th: pa.Array, doc: np.ndarray, at: np.ndarray) -> pa.Array:
    """A text's hash and a place in it as one number."""
    return pa.array((th.to_numpy().astype(np.int64)[doc] << 32) | at)

def _emit_anchors(window: int, rounds: int, longest: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for rb in wh.slices(whole, 2):
                batch, s, at = _parsed(rb, window, rounds, longest, bits)
                chosen = np.zeros(len(s.name) + 1, bool)
                chosen[rc.anchors(s, batch.first, window)] = True
                good = np.flatnonzero(chosen[:-1])
                doc = np.searchsorted(at, good, "right") - 1
                yield pa.RecordBatch.from_arrays([rb.column(0).take(pa.array(doc)), _places(rb.column(1), doc, good - at[doc]), pa.array(s.name[good].view(np.int64))], names=["id", "place", "name"])

    return run

def _candidates(rb: pa.RecordBatch, window: int, rounds: int, longest: int, bits: int) -> tuple[wh.Batch, np.ndarray]:
    """The batch's words, and which windows may repeat given the anchors in column 3 that occur once."""
    batch, s, at = _parsed(rb, window, rounds, longest, bits)
    sole = np.zeros(len(s.name), bool)
    for i in range(rb.num_rows):
        sole[at[i] + _ints(rb.column(3), i)] = True
    return batch, rc.unproven(rc.anchors(s, batch.first, window), batch.first, window, sole)

def _emit_windows(window: int, rounds: int, longest: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for rb in wh.slices(whole, 2):
                batch, may = _candidates(rb, window, rounds, longest, bits)
                at = np.flatnonzero(may)
                doc = np.searchsorted(batch.first, at, "right") - 1
                w1, w2 = window_digests(batch, at, window)
                yield pa.RecordBatch.from_arrays([rb.column(0).take(pa.array(doc)), _places(rb.column(1), doc, at - batch.first[doc]), pa.array(w1.copy()), pa.array(w2.copy())], names=["id", "place", "w1", "w2"])

    return run

def _strike(window: int, rounds: int, longest: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for rb in wh.slices(whole, 2):
                batch, may = _candidates(rb, window, rounds, longest, bits)
                for i in range(rb.num_rows):
                    may[batch.first[i] + _ints(rb.column(4), i)] = False
                n = len(may)
                starts = np.flatnonzero(may)
                cover = np.bincount(starts, minlength=n + 1) - np.bincount(starts + window, minlength=n + 1)[: n + 1]
                gone = np.cumsum(cover)[:n] > 0
                removed, kept = [], []
                raw = batch.data.tobytes()
                for i in range(rb.num_rows):
                    a, b = int(batch.first[i]), int(batch.first[i + 1])
                    stay = np.flatnonzero(~gone[a:b]) + a
                    removed.append(b - a - len(stay))
                    kept.append(b" ".join([raw[x:y] for x, y in zip(batch.start[stay].tolist(), batch.end[stay].tolist(), strict=True)]))
                yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(batch.counts().astype(np.int64)), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["id", "n_words", "n_removed", "kept_text"])

    return run

def _alone(rows: DataFrame, *keys: str) -> DataFrame:
    """The places of keys that occur once."""
    once = rows.groupBy(*keys).agg(F.max("id").alias("id"), F.max("place").alias("place"), F.count(F.lit(1)).alias("n")).where("n = 1")
    return once.select("id", F.shiftright("place", 32).cast("int").alias("th"), F.col("place").bitwiseAND(0x7FFFFFFF).cast("int").alias("at"))

def _lists(rows: DataFrame, name: str) -> DataFrame:
    """A document's own places as one list; its length is bounded by the document's."""
    return rows.groupBy("id", "th").agg(F.collect_set("at").alias(name))

def _beside(docs: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    other = lists.withColumnsRenamed({"id": "__id", "th": "__th"})
    return docs.join(other, docs.id.eqNullSafe(other["__id"]) & (docs.th == other["__th"]), how)

def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = WINDOW, rounds: int = ROUNDS, longest: int = LONGEST, bits: int = 64) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_text (kept words joined by one space).

    ``bits``: of the word hashes that symbols are made of; fewer cost time, not results.
    """
    how = (window, rounds, longest, bits)
    scratch = Scratch(docs.sparkSession, "substring")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.hash(text).alias("th"), text.alias("text"))
    names = rows.mapInArrow(_emit_anchors(*how), "id long, place long, name long")
    sole = scratch.keep(_lists(_alone(names, "name"), "sole"), "sole")
    scratch.settle()
    marked = _beside(rows, sole, "left").select("id", "th", "text", "sole")
    windows = marked.mapInArrow(_emit_windows(*how), "id long, place long, w1 long, w2 long")
    single = scratch.keep(_lists(_alone(windows, "w1", "w2"), "single"), "single")
    scratch.settle()
    both = scratch.keep(
        sole.select("id", "th", "sole", F.lit(None).cast("array<int>").alias("single")).unionByName(single.select("id", "th", F.lit(None).cast("array<int>").alias("sole"), "single"))
        .groupBy("id", "th").agg(F.first("sole", ignorenulls=True).alias("sole"), F.first("single", ignorenulls=True).alias("single")),
        "both",
    )
    scratch.settle()
    done = _beside(rows, both, "left").select("id", "th", "text", "sole", "single").mapInArrow(_strike(*how), "id long, n_words long, n_removed long, kept_text string")
    return done.withColumnRenamed("id", id_col)

def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))

QUERIES = {"op5_substring_dedup": op5_substring_dedup}
ORACLE_SQL = {
    "op5_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        p AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM d WHERE len(ws) >= 35)),
        r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS n FROM p) WHERE n > 1),
        x AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM r),
        w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM d),
        k AS (SELECT w.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY w.j) AS s FROM w ANTI JOIN x ON w.doc_id = x.doc_id AND w.j = x.j GROUP BY w.doc_id)
        SELECT d.doc_id, len(ws)::BIGINT AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
        FROM d LEFT JOIN k USING (doc_id)
    """
}

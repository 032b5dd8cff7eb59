"""Text quality by nearest-neighbour voting in a latent semantic space.

Texts become weighted counts of hashed byte trigrams (case kept), with document
frequencies counted over all documents.  A truncated singular value
decomposition of a bounded labelled sample gives the latent space; the sample's
vectors, at most ``max_labelled`` times ``dims`` numbers, are sent to every
task, which compares each document with all of them by blocked matrix products
and lets the ``k`` nearest vote with their cosine.

Defined results: a null or empty text has no direction, and gets the labels'
mean; rows are scored one by one; without labelled rows every score is 0.5.
Cosines count to six decimals, and all that tie with the ``k``-th nearest vote;
of texts that repeat a labelled id the least votes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import wordhash as wh
from weftline.llm.labels import label_counts, remainder, training_ids

BUCKETS = 1 << 13
#: Labelled rows that vote: a documented bound.
MAX_LABELLED = 3000
DIMS = 48
NEIGHBOURS = 15


def counts(texts: pa.Array) -> np.ndarray:
    """Trigram counts of each text."""
    data, at = wh.text_bytes(texts)
    n = len(data)
    out = np.zeros((len(texts), BUCKETS), np.float32)
    if n < 3:
        return out
    v = (wh._TABLE >> np.uint64(40)).astype(np.uint32)[data]
    h = (v[:-2] * np.uint32(0x9E3779B1)) ^ (v[1:-1] * np.uint32(0x85EBCA77)) ^ (v[2:] * np.uint32(0xC2B2AE3D))
    h = ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(19)).astype(np.int64)
    for i in range(len(texts)):
        a, b = int(at[i]), int(at[i + 1]) - 2
        if b > a:
            out[i] = np.bincount(h[a:b], minlength=BUCKETS)
    return out


def weighted(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return _weigh(tf.copy(), idf)


def _weigh(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """In place, as the training matrix is the largest thing on the driver."""
    np.log1p(x, out=x)
    x *= idf
    for at in range(0, len(x), 256):
        part = x[at : at + 256]
        part /= np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-9)
    return x


@dataclass
class Space:
    idf: np.ndarray
    mean: np.ndarray
    basis: np.ndarray  # buckets x dims
    vectors: np.ndarray  # labelled x dims, of length one
    labels: np.ndarray
    prior: float
    weight: np.ndarray  # of each labelled vector, so that the sample votes as all labels would

    def latent(self, tf: np.ndarray) -> np.ndarray:
        z = (weighted(tf, self.idf) - self.mean) @ self.basis
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def scores(self, texts: pa.Array, k: int) -> np.ndarray:
        tf = counts(texts)
        if not len(self.vectors):
            return np.full(len(texts), self.prior)
        near = np.round(self.latent(tf) @ self.vectors.T, 6)
        at = near.shape[1] - min(k, near.shape[1])
        least = np.partition(near, at, axis=1)[:, at : at + 1]
        vote = np.where(near >= least, np.maximum(near, 1e-6) ** 2 * self.weight, 0).astype(float)
        out = vote @ self.labels / vote.sum(1)
        return np.where(tf.any(axis=1), out, self.prior).astype(float)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(BUCKETS, np.int64), 0
    for whole in batches:
        for rb in wh.slices(whole, 0, 1 << 20):
            for at in range(0, rb.num_rows, 256):
                tf = counts(rb.column(0).slice(at, 256))
                df += (tf > 0).sum(axis=0)
                n += len(tf)
    some = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1).astype(np.int32)), pa.array(np.append(df[some], n))], names=["bucket", "n"])


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for rb in wh.slices(whole, 1, 1 << 20):
            out = []
            for at in range(0, rb.num_rows, 256):
                for row in counts(rb.column(1).slice(at, 256)):
                    some = np.flatnonzero(row)
                    out.append(some.astype(np.uint16).tobytes() + np.minimum(row[some], 65535).astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(out, pa.binary())], names=["label", "tf"])


def train(docs: DataFrame, labels: DataFrame, allowed, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED, dims: int = DIMS) -> Space:
    text = docs.select(F.col(text_col).alias("__text"))
    found = text.mapInArrow(_frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # a row for each bucket
    df = np.zeros(BUCKETS)
    total = 0
    for r in found:
        if r.bucket < 0:
            total = r.n
        else:
            df[r.bucket] = r.n
    idf = np.log((1 + total) / (1 + df)).astype(np.float32) + np.float32(0.1)
    ids = F.broadcast(training_ids(labels, label, allowed, max_labelled, id_col))  # at most max_labelled rows
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(ids, "__id").groupBy("__id", "__label").agg(F.min("__text").alias("__text"))
    rows = rows.select("__label", "__text").mapInArrow(_sparse, "label int, tf binary").collect()
    rows.sort(key=lambda r: (r.tf, r.label))
    shares = label_counts(labels, label, allowed, id_col)
    prior = shares[1] / sum(shares) if sum(shares) else 0.5
    tf = np.zeros((len(rows), BUCKETS), np.float32)
    for i, r in enumerate(rows):
        half = np.frombuffer(r.tf, np.uint16)
        tf[i, half[: len(half) // 2]] = half[len(half) // 2 :]
    y = np.array([r.label for r in rows], np.float32)
    if not len(rows):
        return Space(idf, np.zeros(BUCKETS, np.float32), np.zeros((BUCKETS, 1), np.float32), np.zeros((0, 1), np.float32), y, prior, y)
    del rows
    x = _weigh(tf, idf)
    mean = x.mean(axis=0)
    x -= mean
    start = np.random.default_rng(11).standard_normal((BUCKETS, dims + 16)).astype(np.float32)
    q, _ = np.linalg.qr(x @ start)
    for _ in range(3):
        q, _ = np.linalg.qr(x @ (x.T @ q))
    _, _, v = np.linalg.svd(q.T @ x, full_matrices=False)
    share = np.array([max(1, int((y == c).sum())) for c in (0, 1)])
    weight = np.where(y > 0, max(shares[1], 1) / share[1], max(shares[0], 1) / share[0]) ** 0.5
    basis = np.ascontiguousarray(v[:dims].T)
    z = x @ basis
    return Space(idf, mean, basis, z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9), y, prior, weight.astype(np.float32))


def score(docs: DataFrame, space: Space, k: int = NEIGHBOURS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)`` for each row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in wh.slices(whole, 1, 1 << 20):
                for at in range(0, part.num_rows, 256):
                    rb = part.slice(at, 256)
                    yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(space.scores(rb.column(1), k))], names=["id", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    space = train(docs, labels, remainder("doc_id", 4) != 2)
    return score(docs, space).select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES = {"op3_quality": op3_quality}
ORACLE_SQL: dict[str, str] = {}

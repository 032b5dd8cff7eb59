"""Toxicity by a naive-Bayes-scaled linear classifier over character n-grams.

Features are the hashed byte n-grams that a text has, case folded, each scaled
by its naive Bayes log-count ratio between toxic and other training texts; an
L2-regularised logistic regression is fitted on the scaled features.  Training
uses at most ``max_labelled`` labelled rows, half of either class, with the
intercept moved back to the labels' true shares; scoring is one pass over the
documents and reads whole texts.

What comes to the driver is bounded in bytes, however long the texts: counts of
``BUCKETS`` buckets, a bit for each labelled row and chosen bucket (at most
``max_labelled * BUCKETS / 8`` bytes), and of these at most ``MAX_ENTRIES`` that
are set.  Rows are fitted in the order of their ids, so the fit is the same each
time.

Defined results: a null or empty text has no features and gets the intercept's
score; rows are scored one by one, so repeated ids are no matter; of texts that
repeat a labelled id the least is learnt; without labelled rows of both classes
every score is the labels' share (1e-9 without any).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm import wordhash as wh
from weftline.llm.labels import label_counts, remainder, training_ids
from weftline.plans.scratch import Scratch

ORDERS = (5, 7)
BUCKETS = 1 << 18
#: Labelled rows used for training: a documented bound of the fit.
MAX_LABELLED = 4000
#: Buckets of all training texts that the fit looks at: a documented bound; buckets that tell the classes apart best come first.
MAX_ENTRIES = 1 << 23


def grams(rb_text: pa.Array, orders: tuple[int, ...] = ORDERS, buckets: int = BUCKETS) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order, the bucket of the n-gram at each byte of the batch; and the documents' limits.

    An n-gram that would leave its document is -1.
    """
    data, at = wh.text_bytes(rb_text)
    value = (wh._TABLE >> np.uint64(32)).astype(np.uint32)[wh.LOWER.fold][data]
    n, out = len(data), []
    room = np.repeat(at[1:], np.diff(at)) - np.arange(n)
    for k in orders:
        h = np.zeros(n, np.uint32)
        for j in range(k):
            h *= np.uint32(0x01000193)
            h[: n - j] ^= value[j:]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
        bucket = (h % np.uint32(buckets)).astype(np.int32)
        bucket[room < k] = -1
        out.append(bucket)
    return out, at


@dataclass
class Model:
    weight: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        total = np.full(len(texts), self.bias)
        used = np.append(self.weight != 0, False)
        orders, at = grams(texts)
        doc = np.repeat(np.arange(len(texts)), np.diff(at))
        for bucket in orders:
            hit = np.flatnonzero(used[bucket])
            pair = np.unique(doc[hit] * np.int64(BUCKETS) + bucket[hit])
            np.add.at(total, pair // BUCKETS, self.weight[pair % BUCKETS])
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def chosen(p: np.ndarray, q: np.ndarray, n1: int, n0: int, least: int = 6, deviations: float = 3.0, most: int = MAX_ENTRIES) -> np.ndarray:
    """The buckets to learn from, given how many toxic and other texts have each.

    Buckets that fewer than ``least`` texts have, or whose toxic share is within
    ``deviations`` of what chance gives, are left out.
    """
    share = n1 / (n1 + n0)
    unlikely = np.abs(p - (p + q) * share) / np.sqrt(np.maximum(p + q, 1) * share * (1 - share))
    good = np.flatnonzero((p + q >= least) & (unlikely >= deviations))
    order = good[np.argsort(-unlikely[good], kind="stable")]
    return np.sort(order[np.cumsum((p + q)[order]) <= most])


def fit(bits: list[bytes], labels: np.ndarray, ratio: np.ndarray, shares: tuple[int, int], l2: float = 5.0, rounds: int = 120) -> tuple[np.ndarray, float]:
    """Weights of the chosen buckets and the intercept; bits: which of them each text has."""
    y, n = labels.astype(float), len(labels)
    columns = [np.flatnonzero(np.unpackbits(np.frombuffer(b, np.uint8), count=len(ratio))).astype(np.int32) for b in bits]
    owner = np.repeat(np.arange(n, dtype=np.int32), [len(c) for c in columns])
    column = np.concatenate([*columns, np.zeros(0, np.int32)])
    del columns
    value = ratio[column]
    w, b = np.zeros(len(ratio)), 0.0
    m, v = np.zeros(len(ratio) + 1), np.zeros(len(ratio) + 1)
    for t in range(1, rounds + 1):
        z = np.bincount(owner, value * w[column], n) + b
        g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / n
        grad = np.append(np.bincount(column, value * g[owner], len(ratio)) + l2 * w / n, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = 0.02 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    # The sample is half toxic; the intercept goes back to the labels' own odds.
    shift = np.log(max(shares[1], 1) / max(shares[0], 1)) - np.log(y.sum() / (1 - y).sum())
    return w * ratio, float(b + shift)


def _own(orders: list[np.ndarray], a: int, b: int) -> np.ndarray:
    own = np.unique(np.concatenate([o[a:b] for o in orders]))
    return own[own >= 0]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many toxic and how many other texts have each bucket."""
    n = np.zeros((2, BUCKETS), np.int32)
    for whole in batches:
        for rb in wh.slices(whole, 2):
            orders, at = grams(rb.column(2))
            for i, label in enumerate(rb.column(1).to_pylist()):
                n[label][_own(orders, at[i], at[i + 1])] += 1
    some = np.flatnonzero(n.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[1][some]), pa.array(n[0][some])], names=["bucket", "p", "q"])


def _bits(names: np.ndarray):
    """Each text's chosen buckets as bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(BUCKETS, -1, np.int32)
        place[names] = np.arange(len(names))
        for whole in batches:
            for rb in wh.slices(whole, 2):
                orders, at = grams(rb.column(2))
                out = []
                for i in range(rb.num_rows):
                    own = place[_own(orders, at[i], at[i + 1])]
                    bits = np.zeros(len(names), np.uint8)
                    bits[own[own >= 0]] = 1
                    out.append(np.packbits(bits).tobytes())
                yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), pa.array(out, pa.binary())], names=["id", "label", "bits"])

    return run


def train(docs: DataFrame, labels: DataFrame, allowed, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> Model:
    ids = F.broadcast(training_ids(labels, label, allowed, max_labelled, id_col))  # at most max_labelled rows
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(ids, "__id")
    rows = rows.groupBy(F.col("__id").cast("string").alias("id"), F.col("__label").alias("label")).agg(F.min("__text").alias("text"))
    rows = Scratch(docs.sparkSession, "labelled").keep(rows, "rows")
    classes = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}  # two rows
    shares = label_counts(labels, label, allowed, id_col)
    weight = np.zeros(BUCKETS)
    if len(classes) < 2:
        prior = shares[1] / max(1, sum(shares))
        return Model(weight, float(np.log(max(prior, 1e-9) / max(1 - prior, 1e-9))))
    seen = rows.mapInArrow(_counted, "bucket int, p int, q int").groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("q").alias("q")).toArrow()  # a row for each bucket
    p, q = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = seen.column("bucket").to_numpy()
    p[at], q[at] = seen.column("p").to_numpy(), seen.column("q").to_numpy()
    del seen
    names = chosen(p, q, classes[1], classes[0])
    ratio = np.log(((1 + p) / (classes[1] + 2)) / ((1 + q) / (classes[0] + 2)))[names]
    found = rows.mapInArrow(_bits(names), "id string, label int, bits binary").toArrow()  # a row for each labelled one
    order = np.argsort(np.array(found.column("id").to_pylist(), dtype=object), kind="stable")
    bits = found.column("bits").combine_chunks() if found.num_rows else pa.array([], pa.binary())
    given, taken = found.column("label").to_numpy()[order], [bits[int(i)].as_py() for i in order]
    del found, bits
    weight[names], bias = fit(taken, given, ratio, shares)
    return Model(weight, bias)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)`` for each row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for rb in wh.slices(whole, 1):
                yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(model.scores(rb.column(1)))], names=["id", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = train(docs, labels, remainder("doc_id", 5) != 0)
    scored = score(docs, model)
    return scored.select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", at_least: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose text scores ``at_least``; one pass, no join."""
    model = train(docs, labels, remainder("doc_id", 5) != 0, id_col=id_col, text_col=text_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for rb in wh.slices(whole, at):
                yield rb.filter(pa.array(model.scores(rb.column(at)) < at_least))

    plain = [f"c{i}" for i in range(len(docs.columns))]  # names with dots can't be given to Python
    schema = T.StructType([T.StructField(c, f.dataType) for c, f in zip(plain, docs.schema, strict=True)])
    return docs.toDF(*plain).mapInArrow(run, schema).toDF(*docs.columns)


QUERIES = {"op9_toxicity": op9_toxicity}
ORACLE_SQL: dict[str, str] = {}

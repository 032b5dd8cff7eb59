"""Benchmark passages in documents by a prefix-filtered set join.

A benchmark item is cut into windows of consecutive words; a window is a set of
word shingles that a document contains wholly or not at all.  For containment
one shingle of each window is a sufficient prefix when all are ordered by
rarity, so the documents are probed for each window's rarest shingle only.  A
probe that meets is bound by length (the document has as many words as the
window) and position (the window must lie inside the document at the shingle's
offset), and then verified word for word over the whole window.

Rarity is counted over all documents in a first pass that looks at shingles of
the benchmark only.  The benchmark is read, and sent to the executors, in blocks
of a bounded number of windows, one at a time: each is a pass over the documents
that writes what it finds, and is then forgotten.  So a large benchmark costs
time, not memory.  A benchmark of one block needs no second look at the documents.

Defined results: null and empty texts have no words; items without words, and
items whose id is null, have no windows; repeated items count once per id;
every input row gives one output row, whatever its id.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import wordhash as wh
from weftline.plans.pruning import among, unused
from weftline.plans.scratch import Scratch

WINDOW = 8
SHINGLE = 5
#: Windows sent to the executors at once: about 200 bytes each.
BLOCK_WINDOWS = 200_000


class Windows:
    """A block of item windows, grouped by length, with the items that have each."""

    def __init__(self, items: list[tuple[str, str]], window: int, shingle: int) -> None:
        owners: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        for item, text in items:
            batch = wh.split(pa.array([text]), wh.ALNUM)
            low = wh.ALNUM.fold[batch.data].tobytes()
            words = tuple(low[s:e] for s, e in zip(batch.start, batch.end, strict=True))
            for i in range(max(1, len(words) - window + 1) if words else 0):
                owners[words[i : i + window]].add(item)
        self.words = sorted(owners)
        self.items = [sorted(owners[w]) for w in self.words]
        vocabulary = sorted({w for ws in self.words for w in ws})
        hashes = wh.split(pa.array([b" ".join(vocabulary).decode("utf-8", "surrogateescape")]), wh.ALNUM).hash if vocabulary else np.zeros(0, np.uint64)
        order = np.argsort(hashes)
        self.known = hashes[order]
        self.name = (order + 1).astype(np.int64)  # 0: a word that no window has
        ids = {w: i + 1 for i, w in enumerate(vocabulary)}
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in sorted({len(w) for w in self.words}):
            at = np.array([i for i, w in enumerate(self.words) if len(w) == n])
            self.by_length[n] = (at, np.array([[ids[w] for w in self.words[i]] for i in at], np.int64))
        self.shingle = shingle
        self.prefix: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def names(self, batch: wh.Batch) -> np.ndarray:
        """Each word's number in the block, 0 if no window has it."""
        if not len(self.known):
            return np.zeros(len(batch.hash), np.int64)
        at = np.minimum(np.searchsorted(self.known, batch.hash), len(self.known) - 1)
        return np.where(self.known[at] == batch.hash, self.name[at], 0)

    @staticmethod
    def keys(names: np.ndarray, k: int) -> np.ndarray:
        """A key for the ``k`` names from each position; 0 where one is unknown or the end is near."""
        n = len(names) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        key, whole = np.zeros(n, np.uint64), np.ones(n, bool)
        for j in range(k):
            part = names[j : j + n]
            key = key * np.uint64(0x9E3779B97F4A7C15) + part.astype(np.uint64)
            whole &= part > 0
        return np.where(whole, wh.mix(key) | np.uint64(1), np.uint64(0))

    def shingle_keys(self) -> np.ndarray:
        """Every shingle of every window."""
        found = [np.zeros(0, np.uint64)]
        for n, (_, ids) in self.by_length.items():
            k = min(self.shingle, n)
            found += [self.keys(row, k) for row in ids]
        return np.unique(np.concatenate(found))

    def choose(self, seen: dict[int, int]) -> None:
        """Take each window's rarest shingle (the first of equals) as its prefix."""
        for n, (at, ids) in self.by_length.items():
            k = min(self.shingle, n)
            keys = np.array([self.keys(row, k) for row in ids])
            counts = np.array([[seen.get(int(x), 0) for x in row] for row in keys])
            offset = counts.argmin(axis=1)
            key = keys[np.arange(len(at)), offset]
            order = np.argsort(key, kind="stable")
            self.prefix[n] = (key[order], offset[order], order)

    def find(self, batch: wh.Batch) -> list[tuple[int, int, int]]:
        """(document, first word, window) of each verified occurrence."""
        names, out = self.names(batch), []
        first, docs = batch.first, None
        by_k: dict[int, np.ndarray] = {}
        for n, (at, ids) in self.by_length.items():
            k = min(self.shingle, n)
            if k not in by_k:
                by_k[k] = self.keys(names, k)
            key, offset, order = self.prefix[n]
            own = by_k[k]
            near = np.flatnonzero(own)
            if not len(near):
                continue
            lo, hi = np.searchsorted(key, own[near]), np.searchsorted(key, own[near], "right")
            met = hi > lo
            near, lo, hi = near[met], lo[met], hi[met]
            if docs is None:
                docs = np.repeat(np.arange(len(first) - 1), np.diff(first))
            for p, a, b in zip(near.tolist(), lo.tolist(), hi.tolist(), strict=True):
                d = int(docs[p])
                for j in range(a, b):
                    s = p - int(offset[j])
                    if s < first[d] or s + n > first[d + 1] or not np.array_equal(names[s : s + n], ids[order[j]]):
                        continue
                    window = int(at[order[j]])
                    if all(wh.ALNUM.fold[batch.data[x:y]].tobytes() == w for x, y, w in zip(batch.start[s : s + n], batch.end[s : s + n], self.words[window], strict=True)):
                        out.append((d, s - int(first[d]), window))
        return out


def _count(block: Windows):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = block.shingle_keys()
        total = np.zeros(len(asked), np.int64)
        lengths = sorted({min(block.shingle, n) for n in block.by_length})
        for whole in batches:
            for rb in wh.slices(whole, 0, 1 << 20):
                names = block.names(wh.split(rb.column(0), wh.ALNUM))
                for k in lengths:
                    own = block.keys(names, k)
                    own = own[own > 0]
                    if len(own) and len(asked):
                        i = np.minimum(np.searchsorted(asked, own), len(asked) - 1)
                        total += np.bincount(i[asked[i] == own], minlength=len(asked))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(asked[some].view(np.int64)), pa.array(total[some])], names=["key", "n"])

    return run


def _found(block: Windows, batch: wh.Batch) -> Iterator[tuple[list[int], list[str]] | None]:
    """For each document the covered spans (start, end, start, end ...) and the items, or None."""
    spans: dict[int, list[int]] = defaultdict(list)
    items: dict[int, set[str]] = defaultdict(set)
    for d, s, w in block.find(batch):
        spans[d] += [s, s + len(block.words[w])]
        items[d].update(block.items[w])
    for d in range(len(batch.first) - 1):
        yield (spans[d], sorted(items[d])) if d in spans else None


def _probe(block: Windows):
    """The hits of one block: only documents that have some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for rb in wh.slices(whole, 2, 1 << 20):
                found = list(_found(block, wh.split(rb.column(2), wh.ALNUM)))
                at = [d for d, f in enumerate(found) if f]
                hits = rb.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([hits.column(0), hits.column(1), pa.array([found[d][0] for d in at], pa.list_(pa.int32())), pa.array([found[d][1] for d in at], pa.list_(pa.string()))], names=["id", "th", "spans", "items"])

    return run


def _results(ids: pa.Array, counts: np.ndarray, found: Iterator[tuple[list[int], list[str]] | None], least: int) -> pa.RecordBatch:
    hit, each, digest = [], [], []
    for n, f in zip(counts.tolist(), found, strict=True):
        spans, items = f or ([], [])
        covered = np.zeros(n + 1 if spans else 1, np.int64)
        if spans:
            np.add.at(covered, spans[::2], 1)
            np.subtract.at(covered, spans[1::2], 1)
        hit.append(int((np.cumsum(covered) > 0).sum()))
        each.append(items)
        digest.append(hashlib.sha256(",".join(items).encode()).hexdigest())
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(counts.astype(np.int64)), pa.array(hit, pa.int64()), pa.array([len(x) for x in each], pa.int64()), pa.array(digest), pa.array([len(x) >= least for x in each], pa.bool_()), pa.array(each, pa.list_(pa.string()))],
        names=["id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"],
    )


def _only(block: Windows, least: int):
    """Search and digests where there is one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for rb in wh.slices(whole, 2, 1 << 20):
                batch = wh.split(rb.column(2), wh.ALNUM)
                yield _results(rb.column(0), batch.counts(), _found(block, batch), least)

    return run


def _gathered(least: int):
    """Digests of what the blocks have found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for rb in wh.slices(whole, 2, 1 << 20):
                spans, items = rb.column(3).to_pylist(), rb.column(4).to_pylist()
                yield _results(rb.column(0), wh.split(rb.column(2), wh.ALNUM).counts(), (((s or []), sorted({*(i or ())})) for s, i in zip(spans, items, strict=True)), least)

    return run


def benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, shingle: int, block_windows: int) -> Iterator[tuple[Windows, bool]]:
    """The benchmark as blocks of at most about ``block_windows`` windows, read item by item; and whether more follow."""
    items, n = [], 0
    rows = benchmark.where(F.col(item_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(item_col).cast("string"), text_col).orderBy(item_col)
    for item, text in rows.toLocalIterator():
        if n > block_windows * 8:
            yield Windows(items, window, shingle), True
            items, n = [], 0
        items.append((item, text))
        n += len(text) // 2
    yield Windows(items, window, shingle), False


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *, window: int = WINDOW, shingle: int = SHINGLE, least_items: int = 2, block_windows: int = BLOCK_WINDOWS
) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated, items."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    schema = f"id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>"
    scratch, hits = Scratch(docs.sparkSession, "windows"), []
    for block, more in benchmark_blocks(benchmark, item_col, item_text_col, window, shingle, block_windows):
        counts = rows.select("text").mapInArrow(_count(block), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
        # At most a row for each shingle of the block.
        block.choose({int(np.int64(r.key).view(np.uint64)): r.n for r in counts.collect()})
        if not hits and not more:
            return rows.mapInArrow(_only(block, least_items), schema).withColumnRenamed("id", id_col)
        hits.append(scratch.keep(rows.mapInArrow(_probe(block), f"id {kind}, th long, spans array<int>, items array<string>"), "hits"))
    # Rows that repeat id and text have the same hits, so one of each is enough.
    each = [h.dropDuplicates(["id", "th"]) for h in hits]
    every = reduce(DataFrame.unionByName, each).groupBy("id", "th").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    every = scratch.keep(every.withColumnsRenamed({"id": "__id", "th": "__th"}), "every")
    may, others = among(rows, [F.col("id"), F.col("th")], every.select("__id", "__th"), scratch)
    met = may.join(every, F.col("id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th")), "left").select("id", "th", "text", "spans", "items")
    others = others.select("*", F.lit(None).cast("array<int>").alias("spans"), F.lit(None).cast("array<string>").alias("items"))
    return met.unionByName(others).mapInArrow(_gathered(least_items), schema).withColumnRenamed("id", id_col)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without the documents that hold windows of ``least_items`` benchmark items.

    Rows that repeat an id are judged by their own texts.
    """
    scratch = Scratch(docs.sparkSession, "contaminated")
    named, own, text, bad_id, bad_text = (unused(n, docs) for n in ("__named", "__own", "__text", "__bad_id", "__bad_text"))
    name = F.struct(F.col(id_col).alias("a"), F.xxhash64(text_col).alias("b"))  # a document's id and text
    bad = contamination(docs.select(name.alias(named), text_col), benchmark, named, text_col, **how).where("contaminated")
    bad = scratch.keep(bad.select(F.col(f"{named}.a").alias(bad_id), F.col(f"{named}.b").alias(bad_text)).distinct(), "bad")
    keyed = docs.withColumns({own: F.col(id_col), text: F.xxhash64(text_col)})
    may, others = among(keyed, [F.col(own), F.col(text)], bad, scratch)
    clean = may.join(bad, F.col(own).eqNullSafe(F.col(bad_id)) & (F.col(text) == F.col(bad_text)), "left_anti")
    return others.unionByName(clean).drop(own, text)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(docs, bench).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


QUERIES = {"op2_decontaminate": op2_decontaminate}
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = {
    "op2_decontaminate": f"""
        WITH b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark WHERE item_id IS NOT NULL),
        bw AS (SELECT item_id, least(len(ws), 8) AS n, unnest(list_transform(range(1, greatest(len(ws) - 7, 1) + 1), lambda i: array_to_string(ws[i:i + 7], ' '))) AS g FROM b WHERE len(ws) > 0),
        d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
        p AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d),
        k AS (SELECT DISTINCT n FROM bw),
        dw AS (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS g FROM p, k WHERE i + n - 1 <= len(ws)),
        m AS (SELECT dw.doc_id, i, bw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
        h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM m) GROUP BY doc_id),
        t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM m GROUP BY doc_id)
        SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(s, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
        FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
    """
}

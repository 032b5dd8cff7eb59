"""Connected components by contraction.

Every task first contracts the edges that it reads by itself: a union-find over
chunks of bounded size gives each of their nodes a root.  A node's roots, one
for each chunk that saw it, are then gathered by one aggregation; nodes with
several roots say which roots belong together, and these are the edges of the
next, smaller graph.  Roots are the least by a salted hash, so a chain shrinks
by a third a round in the worst case, and mostly one or two rounds do.

Edges and labels stay distributed; no row is joined by a node of many edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.plans.scratch import Scratch

#: Edges that a task contracts at a time.
CHUNK = 2_000_000


def local_roots(u: np.ndarray, v: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of these edges, and for each the root of its piece."""
    nodes = np.unique(np.concatenate([u, v]))
    x = nodes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt * 0x632BE59BD9B4E019 % 2**64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    order = np.argsort(x ^ (x >> np.uint64(29)), kind="stable")
    rank = np.empty(len(nodes), np.int64)
    rank[order] = np.arange(len(nodes))
    up, a, b = np.arange(len(nodes)), rank[np.searchsorted(nodes, u)], rank[np.searchsorted(nodes, v)]
    while len(a):
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = up[up]
            if (further == up).all():
                break
            up = further
        a, b = up[a], up[b]
        apart = a != b
        a, b = a[apart], b[apart]
    return nodes, nodes[order][up[rank]]


def _contracted(salt: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def rows() -> pa.RecordBatch:
            found = local_roots(*(np.concatenate(part) for part in zip(*held, strict=True)), salt)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["node", "root"])

        for rb in batches:
            held.append((rb.column(0).to_numpy(zero_copy_only=False), rb.column(1).to_numpy(zero_copy_only=False)))
            if sum(len(x) for x, _ in held) >= CHUNK:
                yield rows()
        if held:
            yield rows()

    return run


def components(edges: DataFrame, a: str, b: str, scratch: Scratch | None = None) -> DataFrame:
    """``(node, component)`` for every node of an edge; the component is its least node.

    Null ends and self links are ignored; repeated and reversed edges count once.
    """
    scratch = scratch or Scratch(edges.sparkSession, "components")
    now = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    levels: list[DataFrame] = []
    while True:
        roots = now.mapInArrow(_contracted(len(levels)), "node long, root long").groupBy("node").agg(F.sort_array(F.collect_set("root")).alias("roots"))
        levels.append(scratch.keep(roots, "roots"))
        several = levels[-1].where("size(roots) > 1").select(F.col("roots")[0].alias("u"), F.explode(F.expr("slice(roots, 2, size(roots))")).alias("v"))
        now = scratch.keep(several.distinct(), "edges")
        if now.isEmpty():
            break
    named = levels[0].select("node", F.col("roots")[0].alias("root"))
    for level in levels[1:]:
        above = level.select(F.col("node").alias("root"), F.col("roots")[0].alias("above"))
        named = named.join(above, "root", "left").select("node", F.coalesce("above", "root").alias("root"))
    named = scratch.keep(named, "named")
    least = named.groupBy("root").agg(F.min("node").alias("component"))
    return scratch.keep(named.join(least, "root").select("node", "component"), "labels")

"""What the texts of pairs have in common, found where the pairs met.

A text goes once to each place where its document has a pair, with the pairs of
the place, so it isn't repeated for each of its pairs, and no words are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.operators import meeting as M
from weftline.plans.pruning import among
from weftline.plans.scratch import Scratch

#: Words of all pairs, and of all texts, that are looked at at once.
WORDS, KINDS = 1 << 21, 1 << 16


class _Bags:
    """The bags of some lists of strings, numbered: ids in order with their counts, and where each list's begin."""

    def __init__(self, lists: pa.ListArray) -> None:
        at = lists.offsets.to_numpy().astype(np.int64)
        self.sizes = np.diff(at)
        ids = lists.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(self.sizes)), self.sizes)
        width = int(ids.max(initial=0)) + 1
        both, self.counts = np.unique(row * width + ids, return_counts=True)
        self.ids = both % width
        self.kinds = np.bincount(both // width, minlength=len(self.sizes))
        self.at = np.append(0, np.cumsum(self.kinds))

    def common(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs of lists, what both have with repeats and without."""
        many, few = np.zeros(len(one), dtype=np.int64), np.zeros(len(one), dtype=np.int64)
        order = np.argsort(two, kind="stable")
        begin = 0
        work = np.cumsum(self.kinds[one[order]] + 1)
        new = np.cumsum(np.where(np.append(True, two[order][1:] != two[order][:-1]), self.kinds[two[order]] + 64, 0))
        while begin < len(order):
            end = int(np.searchsorted(work, (work[begin - 1] if begin else 0) + WORDS, side="right"))
            end = min(end, int(np.searchsorted(new, (new[begin - 1] if begin else 0) + KINDS, side="right")))
            part = order[begin : max(end, begin + 1)]
            who, p, q = M.shared(self.ids, self.at, one[part], two[part])
            many[part] = np.bincount(who, weights=np.minimum(self.counts[p], self.counts[q]), minlength=len(part)).astype(np.int64)
            few[part] = np.bincount(who, minlength=len(part))
            begin += len(part)
        return many, few


def _read(batches: Iterator[pa.RecordBatch], carried: list[str], sentences: bool) -> Iterator[pa.RecordBatch]:
    for t in M.whole_groups(batches, M.PLACE):
        # several places at once: a text of each is a list of its own
        begin = M.starts(t, M.PLACE)
        place = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, t.num_rows)))
        pair = M.numbers(t, "is_pair").astype(bool)
        rows = np.flatnonzero(~pair)
        asked = np.flatnonzero(pair)
        if not len(asked):
            continue
        texts = t.take(pa.array(rows))
        words = _Bags(pc.split_pattern(texts.column("words").combine_chunks(), " "))
        own = M.numbers(texts, "doc1")
        order = np.lexsort((own, place[rows]))
        # the text of a document in a place, by its number among the sorted ones
        _, doc = np.unique(np.concatenate([own, M.numbers(t, "doc1")[asked], M.numbers(t, "doc2")[asked]]), return_inverse=True)
        n = int(doc.max()) + 1
        known = place[rows][order] * n + doc[: len(own)][order]
        find = lambda d: order[np.searchsorted(known, place[asked] * n + d)]
        one, two = find(doc[len(own) : len(own) + len(asked)]), find(doc[len(own) + len(asked) :])
        many, few = words.common(one, two)
        found = {"common": many, "kinds": few, "size1": words.sizes[one], "size2": words.sizes[two], "kinds1": words.kinds[one], "kinds2": words.kinds[two]}
        if sentences:
            found["sentence"] = _Bags(texts.column("st").combine_chunks()).common(one, two)[1] > 0
        out = t.select(carried).take(pa.array(asked))
        for name, values in found.items():
            out = out.append_column(name, pa.array(values))
        yield from out.combine_chunks().to_batches(M.ROWS)


def together(pairs: DataFrame, docs: DataFrame, scratch: Scratch, sentences: bool = False) -> DataFrame:
    """Add to pairs (doc1, doc2) what their texts have in common.

    ``pairs`` is a kept table, with the place where a pair met; without, a pair
    meets at its first document.  ``docs``: doc_id, text, lang.  Columns: common and
    kinds (tokens that both have, with repeats and without), size1, size2,
    kinds1, kinds2, and sentence (whether a long sentence is in both) if asked for.
    """
    carried = pairs.columns
    if "key" not in carried:
        pairs = pairs.select("*", F.col("doc1").alias("key"), F.lit(0).alias("bucket"), F.lit(0).alias("part"))
    asked = pairs.select(*M.PLACE, F.explode(F.array("doc1", "doc2")).alias("doc_id")).distinct()
    asked = scratch.keep(asked, "asked")
    ids = scratch.keep(asked.select("doc_id").distinct(), "ids")
    own, _ = among(docs.select("doc_id", "text", "lang"), [F.col("doc_id")], ids, scratch)
    st = X.sentences(F.col("text"), F.col("lang")) if sentences else F.array().cast("array<string>")
    own = own.select("doc_id", X.clean(F.col("text")).alias("words"), st.alias("st"))
    texts = asked.join(own.hint("merge"), "doc_id").select(*M.PLACE, F.lit(0).alias("is_pair"), F.col("doc_id").alias("doc1"), "words", "st")
    rows = texts.unionByName(pairs.withColumn("is_pair", F.lit(1)), allowMissingColumns=True)
    rows = rows.repartition(*M.PLACE).sortWithinPartitions(*M.PLACE, "is_pair")
    kinds = dict(pairs.dtypes)
    schema = [*(f"`{c}` {kinds[c]}" for c in carried), *(f"{c} long" for c in ("common", "kinds", "size1", "size2", "kinds1", "kinds2")), *(["sentence boolean"] if sentences else [])]
    return rows.mapInArrow(lambda batches: _read(batches, carried, sentences), ", ".join(schema))

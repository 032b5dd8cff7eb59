"""Which rows can meet a set of keys, without a shuffle of the rows.

A join of wide rows with a few keys moves every row to meet them, unless the
keys are few enough to be broadcast.  Here the keys' hashes set bits in bitmaps
of 32,768 bits, about ``BITS`` bits for each key, and at most ``MOST_PARTS``
bitmaps: 8 MiB in all, whatever the number of keys.  They are broadcast, and
rows whose bit is not set are known not to meet any key.  The others go on to
an exact join or grouping; with more keys than the bitmaps can tell apart more
of them do, and the result is the same.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.plans.scratch import Scratch

PART = 32_768
MOST_PARTS = 2048
BITS = 64


def unused(name: str, *frames: DataFrame) -> str:
    """``name``, with underscores before it until no frame has such a column."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def quoted(*names: str) -> list[Column]:
    """Columns by their very names, dots and all."""
    return [F.col(f"`{n.replace('`', '``')}`") for n in names]


def among(rows: DataFrame, columns: list[Column], keys: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The rows whose ``columns`` may be a row of ``keys``, and those for which they are none.

    ``keys`` is a kept table whose columns have the types of ``columns``, in
    their order; it is counted and read once more.  Nulls are values.
    """
    parts = min(MOST_PARTS, max(1, math.ceil(keys.count() * BITS / PART)))
    part, bit, bits = (unused(n, rows) for n in ("__part", "__bit", "__bits"))
    place = lambda *c: F.pmod(F.xxhash64(*c), F.lit(parts * PART))
    split = lambda h: [F.floor(h / PART).cast("int").alias(part), (h % PART).cast("int").alias(bit)]
    maps = keys.select(place(*quoted(*keys.columns)).alias("h")).select(*split(F.col("h"))).groupBy(part).agg(F.bitmap_construct_agg(bit).alias(bits))
    maps = scratch.keep(maps, "bitmaps")
    met = rows.select("*", *split(place(*columns))).join(F.broadcast(maps), part, "left")  # at most MOST_PARTS rows of 4 KiB
    byte = F.conv(F.hex(F.expr(f"substring({bits}, {bit} div 8 + 1, 1)")), 16, 10).cast("int")
    there = F.coalesce(F.getbit(byte, F.col(bit) % 8) == 1, F.lit(False))
    return met.where(there).select(*quoted(*rows.columns)), met.where(~there).select(*quoted(*rows.columns))

"""Near-duplicates by MinHash bands, odd sketches and exact verification.

Each document's distinct word shingles give MinHash samples.  The samples are
hashed into bands for candidate search, and folded into an odd sketch: a
bitmap holding, for each bit, the parity of the samples that fall on it.  The
population count of the XOR of two sketches estimates how many samples differ,
which is sharp for high similarities, so all but a few candidates are settled
before any text is read; what remains is verified on full shingle sets, and
each link at last on the words themselves, not on their hashes.

Large groups: equal shingle sets are one class from the start.  In the buckets
of the first bands each member is verified against the one centre whose sketch
is nearest, which joins most of each group.  Then all bands are searched: a
bucket whose members all lie in one component is finished, as more links could
join nothing.  From the others those members go that provably link with no
other: a shingle that no other searched document holds is missing from every
intersection and is part of every union, which bounds the similarity from
above.  What is left of a bucket is split into blocks of bounded size, each a
task's unit of work: there pairs of different components pass the bounds, the
sketches, and at last the full sets, and no pair leaves a block but a link.

Texts are never moved as a whole: bitmaps of bounded size tell which documents
a step asks for, and only their texts meet its pairs.

Defined results: null and blank texts have an empty set and link with nothing;
texts of fewer words than a shingle are one shingle; rows that repeat an id are
one document if their sets are equal, else they share its links; a null id is
returned with a null component of its own and is never linked.  ``drop_near``
keeps one of the rows that repeat both id and text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import wordhash as wh
from weftline.llm.exact import one_of
from weftline.operators.components import components
from weftline.plans.pruning import among, unused
from weftline.plans.scratch import Scratch

BITS = 1024
#: Samples in the odd sketch: the least hash in each of ``BINS`` ranges under ``SAMPLES // BINS`` permutations.
SAMPLES, BINS = 512, 32
_LANES = BITS // 64
#: Rows of a document's shingle matrix are cut so that a text of any length fits.
_COLUMNS = 8192
#: Bands of the first round, which joins most of each group before all bands are searched.
FIRST_BANDS = 8
#: A block holds about so many members of a bucket, or of each of two parts of a large one.
BLOCK = 256


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(40_961)
    return rng.integers(0, 2**32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, n, dtype=np.uint32)


def sketch_limit(similarity: float, samples: int = SAMPLES, bits: int = BITS, deviations: float | None = 6.0) -> int:
    """The population count that two sets of this similarity stay under, but for so many deviations; without any, the largest count.

    Of ``samples`` about ``samples * (1 - similarity)`` differ, and each puts two
    differing items on the bitmap.  The deviation is that of the samples and that
    of the bitmap together.  Ranges that are empty on both sides agree, which only
    lowers the count.
    """
    if deviations is None:
        return bits
    items = 2 * samples * (1 - similarity)
    slope = (1 - 2 / bits) ** items
    drawn = 2 * math.sqrt(samples * similarity * (1 - similarity)) * slope
    folded = math.sqrt(bits / 4 * (1 - (1 - 4 / bits) ** items))
    return math.ceil(bits / 2 * (1 - slope) + deviations * math.hypot(drawn, folded))


def sketched(low: np.ndarray) -> np.ndarray:
    """The samples of one set (32-bit hashes) for its odd sketch; the bound of a range stands for an empty one."""
    a, b = _coefficients(SAMPLES // BINS)
    floor = np.arange(BINS, dtype=np.uint32) * np.uint32(2**32 // BINS)
    least = np.full((len(a), BINS), 0xFFFFFFFF, np.uint32)
    for j in range(0, len(low), _COLUMNS):
        part = np.multiply.outer(a, low[j : j + _COLUMNS])
        part += b[:, None]
        part.sort(axis=1)
        for row, own in zip(part, least, strict=True):
            at = np.searchsorted(row, floor)
            there = at < len(row)
            own[there] = np.minimum(own[there], row[at[there]])
    top = floor + np.uint32(2**32 // BINS - 1)
    return np.where(least <= top, least, floor).ravel()


def signatures(texts: pa.Array, shingle: int, bands: int, rows: int) -> dict[str, np.ndarray]:
    """Set size, two set hashes, band keys and odd sketch of each text."""
    batch = wh.split(texts, wh.LOWER)
    hashes, first = wh.shingles(batch, shingle)
    n, k = len(texts), bands * rows
    a, b = _coefficients(k)
    size, f1, f2 = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    least = np.full((n, k), 0xFFFFFFFF, np.uint32)
    drawn = np.zeros((n, SAMPLES), np.uint32)
    for i in np.flatnonzero(np.diff(first)):
        own = np.unique(hashes[first[i] : first[i + 1]])
        size[i] = len(own)
        f1[i], f2[i] = own.sum(), wh.mix(own ^ np.uint64(0xA5A5)).sum()
        low = (own >> np.uint64(32)).astype(np.uint32)
        for j in range(0, len(low), _COLUMNS):
            part = np.multiply.outer(a, low[j : j + _COLUMNS])
            part += b[:, None]
            np.minimum(least[i], part.min(axis=1), out=least[i])
        drawn[i] = sketched(low)
    lane = np.arange(k, dtype=np.uint64) << np.uint64(32)
    samples = wh.mix(least.astype(np.uint64) | lane)
    keys = np.zeros((n, bands), np.uint64)
    for r in range(rows):
        keys = keys * np.uint64(0x9E3779B97F4A7C15) + samples[:, r::rows]
    keys = wh.mix(keys)
    lane = np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32)
    bit = (wh.mix(drawn.astype(np.uint64) | lane) >> np.uint64(32)).astype(np.int64) % BITS
    odd = np.bincount((bit + np.arange(n)[:, None] * BITS).ravel(), minlength=n * BITS).reshape(n, BITS) & 1
    lanes = np.packbits(odd.astype(np.uint8), axis=1).view(np.int64).reshape(n, _LANES)
    return {"n": size, "f1": f1.view(np.int64), "f2": f2.view(np.int64), "keys": keys.view(np.int64), "odd": lanes}


def _signature_rows(shingle: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for rb in wh.slices(whole, 1, 1 << 20):
                s = signatures(rb.column(1), shingle, bands, rows)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(0, len(s["n"]) * bands + 1, bands, dtype=np.int32)), pa.array(s["keys"].ravel()))
                yield pa.RecordBatch.from_arrays(
                    [rb.column(0), pa.array(s["n"]), pa.array(s["f1"]), pa.array(s["f2"]), keys, *(pa.array(s["odd"][:, j].copy()) for j in range(_LANES))],
                    names=["id", "n", "f1", "f2", "keys", *(f"o{j}" for j in range(_LANES))],
                )

    return run


def word_shingles(text: str | None, shingle: int) -> set[tuple[bytes, ...]]:
    """The distinct shingles of a text as words; A-Z are lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII letters and white space only
    return {tuple(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set()


def _verified(shingle: int, percent: int):
    """Keep the pairs whose shingle sets, as words, have at least ``percent`` in a hundred in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            keep = []
            for x, y in zip(rb.column(2), rb.column(3), strict=True):
                one, two = (word_shingles(v.as_py(), shingle) for v in (x, y))
                both = len(one & two)
                keep.append(both > 0 and 100 * both >= percent * (len(one) + len(two) - both))
            yield pa.RecordBatch.from_arrays([rb.column(0).filter(pa.array(keep, pa.bool_())), rb.column(1).filter(pa.array(keep, pa.bool_()))], names=["a", "b"])

    return run


def _sets(shingle: int):
    """The distinct shingles of each text, and their sum, which names the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for rb in wh.slices(whole, 1, 1 << 20):
                hashes, first = wh.shingles(wh.split(rb.column(1), wh.LOWER), shingle)
                own = [np.unique(hashes[i:j]) for i, j in pairwise(first)]
                ends = np.cumsum([0, *map(len, own)]).astype(np.int32)
                f1 = np.array([x.sum(dtype=np.uint64) for x in own], np.uint64).view(np.int64)
                sets = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(own).view(np.int64)))
                yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(f1), sets], names=["id", "f1", "set"])

    return run


def block_links(parts: list[pa.RecordBatch], percent: int, limit: int) -> list[tuple[int, int]]:
    """Links that join the components of one block's members; pairs that also share an earlier band are left to that band."""
    column = lambda c: pa.concat_arrays([p.column(c) for p in parts])
    ids, n, u, label, part = (column(c).to_numpy() for c in ("id", "n", "u", "label", "c"))
    band, across = parts[0].column("band")[0].as_py(), parts[0].column("i")[0].as_py() != parts[0].column("j")[0].as_py()
    sets = column("set")
    _, token = np.unique(sets.flatten().to_numpy(), return_inverse=True)
    own = np.split(token, np.cumsum(sets.value_lengths().to_numpy())[:-1])
    keys = column("keys").flatten().to_numpy().reshape(len(ids), -1)[:, :band]
    odd = np.stack([column(f"o{j}").to_numpy() for j in range(_LANES)], axis=1).view(np.uint64)
    piece = np.unique(label, return_inverse=True)[1]
    seen = np.zeros(len(token), bool)
    out = []
    for a in range(len(ids) - 1):
        b = a + 1 + np.flatnonzero(piece[a + 1 :] != piece[a])
        if across:
            b = b[part[b] != part[a]]
        b = b[percent * np.maximum(n[a] + u[b], n[b] + u[a]) <= 100 * np.minimum(n[a] - u[a], n[b] - u[b])]
        b = b[~(keys[b] == keys[a]).any(axis=1)]
        b = b[np.bitwise_count(odd[b] ^ odd[a]).sum(axis=1, dtype=np.int64) <= limit]
        if not len(b):
            continue
        seen[own[a]] = True
        for x in b:
            if piece[x] == piece[a]:
                continue
            both = np.count_nonzero(seen[own[x]])
            if 100 * both >= percent * (n[a] + n[x] - both):
                out.append((int(ids[a]), int(ids[x])))
                piece[piece == piece[x]] = piece[a]
        seen[own[a]] = False
    return out


def _blocks(percent: int, limit: int):
    """Rows come sorted by block; a block is held whole, and nothing else is."""

    def batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[s] for x in links], pa.int64()) for s in (0, 1)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for rb in batches:
            links: list[tuple[int, int]] = []
            names = np.stack([rb.column(c).to_numpy() for c in ("key", "i", "j")])
            cuts = np.flatnonzero((names[:, 1:] != names[:, :-1]).any(axis=0)) + 1
            for s, e in pairwise([0, *cuts.tolist(), rb.num_rows]):
                if held and now != tuple(names[:, s]):
                    links += block_links(held, percent, limit)
                    held = []
                now = tuple(names[:, s])
                held.append(rb.slice(s, e - s))
            yield batch(links)
        if held:
            yield batch(block_links(held, percent, limit))

    return run


def _differing(left: str, right: str) -> Column:
    return sum((F.bit_count(F.col(f"{left}o{j}").bitwiseXOR(F.col(f"{right}o{j}"))) for j in range(1, _LANES)), F.bit_count(F.col(f"{left}o0").bitwiseXOR(F.col(f"{right}o0"))))


class NearDuplicates:
    """One run over one table; see the module's text."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int, bands: int, rows: int, deviations: float | None) -> None:
        self.scratch = Scratch(docs.sparkSession, "near")
        self.docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        self.shingle, self.percent = shingle, percent
        self.limit = sketch_limit(percent / 100, deviations=deviations)
        schema = "id long, n long, f1 long, f2 long, keys array<long>, " + ", ".join(f"o{j} long" for j in range(_LANES))
        self.signed = self.scratch.keep(self.docs.mapInArrow(_signature_rows(shingle, bands, rows), schema), "signatures")

    def classes(self) -> DataFrame:
        """A representative of each distinct set, with its signature."""
        columns = ["keys", *(f"o{j}" for j in range(_LANES))]
        filled = self.signed.where("n > 0 AND id IS NOT NULL")
        groups = filled.groupBy("f1", "f2", "n").agg(F.min(F.struct("id", *columns)).alias("r"))
        return self.scratch.keep(groups.select("r.id", "f1", "f2", "n", *(f"r.{c}" for c in columns)), "reps")

    def verify(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of distinct texts that are similar enough, on full sets."""
        texts = self.asked(pairs.select(F.explode(F.array("a", "b")).alias("id")))
        full = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
        links = self.scratch.keep(full.select("a", "b", "ta", "tb").mapInArrow(_verified(self.shingle, self.percent), "a long, b long"), "links")
        self.scratch.settle()
        return links

    def asked(self, ids: DataFrame) -> DataFrame:
        """The documents that may be among these ids; a join decides."""
        ids = self.scratch.keep(ids.distinct(), "asked")
        return among(self.docs, [F.col("id")], ids, self.scratch)[0]

    def near(self, pairs: DataFrame, odd: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) whose sketches are near enough, with their distance d."""
        left, right = (odd.select(F.col("id").alias(s), *(F.col(f"o{j}").alias(f"{s}o{j}") for j in range(_LANES))) for s in "ab")
        met = pairs.join(left, "a").join(right, "b").withColumn("d", _differing("a", "b"))
        return self.scratch.keep(met.where(F.col("d") <= self.limit).select("a", "b", "d"), name)

    def nearest(self, near: DataFrame) -> DataFrame:
        """For each member b the centre a with the nearest sketch."""
        return self.scratch.keep(near.groupBy("b").agg(F.min(F.struct("d", "a")).alias("m")).select("m.a", "b"), "nearest")

    def labels(self, links: DataFrame) -> DataFrame:
        return components(links, "a", "b", self.scratch).withColumnRenamed("node", "id")

    def opened(self, rows: DataFrame, name: str) -> DataFrame:
        """The members of buckets that hold several components, but for those that can link with none of the others."""
        p = self.percent
        buckets = rows.groupBy("key").agg(
            F.min("label").alias("l1"), F.max("label").alias("l2"), F.count(F.lit(1)).alias("m"),
            F.min("n").alias("least"), F.min("u").alias("lone"), F.max(F.col("n") - F.col("u")).alias("most"),
        )
        fits = p * F.greatest(F.col("n") + F.col("lone"), F.col("least") + F.col("u")) <= 100 * F.least(F.col("n") - F.col("u"), "most")
        return self.scratch.keep(rows.join(buckets.where("l1 < l2"), "key").where(fits).select(*rows.columns), name)

    def weeded(self, rows: DataFrame, sets: DataFrame) -> DataFrame:
        """``rows`` with ``u``, the number of shingles that no other document among them holds, as far as links are possible."""
        p = self.percent
        here = rows.select("id", "f1").distinct()
        shown = sets.join(here, ["id", "f1"], "left_semi").select("id", "f1", F.explode("set").alias("h"))
        once = shown.groupBy("h").agg(F.min("id").alias("id"), F.min("f1").alias("f1"), F.count(F.lit(1)).alias("c")).where("c = 1")
        lone = self.scratch.keep(once.groupBy("id", "f1").agg(F.count(F.lit(1)).alias("u")), "lone")
        marked = rows.drop("u").join(lone, ["id", "f1"], "left").withColumn("u", F.coalesce("u", F.lit(0).cast("long"))).select(*rows.columns)
        # a partner has at least the share p of n shingles
        possible = marked.where(p * (p * F.col("n") + 100 * F.col("u")) <= 10_000 * (F.col("n") - F.col("u")))
        return self.opened(self.scratch.keep(possible, "possible"), "weeded")

    def searched(self, rows: DataFrame, sets: DataFrame, reps: DataFrame) -> DataFrame:
        """Links (a, b) between different components that share a bucket."""
        keep = self.scratch.keep
        here = keep(rows.select("id", "f1").distinct(), "here")
        sets, signed = (among(df, [F.col("id"), F.col("f1")], here, self.scratch)[0] for df in (sets, reps.select("id", "f1", "keys", *(f"o{j}" for j in range(_LANES)))))
        members = sets.join(signed, ["id", "f1"])
        parts = F.ceil(F.col("m") / BLOCK).cast("int")
        placed = rows.join(keep(rows.groupBy("key").agg(F.count(F.lit(1)).alias("m")), "counted"), "key").withColumn("c", F.pmod(F.xxhash64("id"), parts).cast("int"))
        spread = placed.withColumn("x", F.explode(F.sequence(F.lit(0), parts - 1))).select(*rows.columns, "c", F.least("c", "x").alias("i"), F.greatest("c", "x").alias("j"))
        blocks = spread.join(members, ["id", "f1"]).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
        return keep(blocks.mapInArrow(_blocks(self.percent, self.limit), "a long, b long"), "found")

    def links(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Representatives, verified links between them, and their components."""
        keep = self.scratch.keep
        reps = self.classes()
        odd = reps.select("id", *(f"o{j}" for j in range(_LANES))).dropDuplicates(["id"])
        rows = reps.select("id", F.explode(F.slice("keys", 1, FIRST_BANDS)).alias("key"))
        buckets = keep(rows.groupBy("key").agg(F.min("id").alias("c"), F.max("id").alias("top")).where("top > c").select("key", "c"), "buckets")
        rows, _ = among(rows, [F.col("key")], buckets.select("key"), self.scratch)
        pairs = keep(rows.join(buckets, "key").where("id > c").select(F.col("c").alias("a"), F.col("id").alias("b")).distinct(), "starred")
        near = self.near(pairs, odd, "near")
        centred = self.nearest(near)
        links = self.verify(centred)
        self.scratch.drop(buckets, pairs, near, centred)
        labels = self.labels(links)
        self.scratch.settle()
        # all bands; labels are joined before a document's keys are spread
        labelled = keep(reps.select("id", "f1", "n", "keys").join(labels, "id", "left").select("id", "f1", "n", F.coalesce("component", "id").alias("label"), "keys"), "labelled")
        mixed = labelled.select(F.explode("keys").alias("key"), "label").groupBy("key").agg(F.min("label").alias("l1"), F.max("label").alias("l2")).where("l1 < l2").select("key")
        mixed = keep(mixed, "mixed")
        spread = labelled.select(F.posexplode("keys").alias("band", "key"), "id", "f1", "n", "label", F.lit(0).cast("long").alias("u"))
        rows = self.opened(among(spread, [F.col("key")], mixed, self.scratch)[0], "active")
        sets = keep(self.asked(rows.select("id")).mapInArrow(_sets(self.shingle), "id long, f1 long, set array<long>"), "sets")
        self.scratch.drop(labelled, mixed)
        many = rows.count()
        while many:
            rows = self.weeded(rows, sets)
            before, many = many, rows.count()
            if many > 0.9 * before:
                break
        self.scratch.settle()
        found = self.searched(rows, sets, reps)
        self.scratch.drop(sets)
        self.scratch.settle()
        links = keep(links.union(self.verify(found)), "links")
        return reps, links, self.labels(links)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 5, percent: int = 80, bands: int = 32, rows: int = 4, deviations: float | None = 6.0) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept (id = component_id).

    Links are ``100 * intersection >= percent * union`` of distinct ``shingle``-word
    shingles.  ``bands`` of ``rows`` samples miss a pair of similarity s with
    probability ``(1 - s**rows)**bands``: 6e-11 at 0.85, 5e-8 at 0.8.  Pairs whose
    sketches differ by ``deviations`` more than such a pair's should are left out
    (about 1e-9 of the links); None leaves that to the full sets alone.
    """
    run = NearDuplicates(docs, id_col, text_col, shingle, percent, bands, rows, deviations)
    reps, _, labels = run.links()
    named = run.scratch.keep(
        reps.select("id", "f1", "f2", "n").join(labels, "id", "left").select("f1", "f2", "n", F.coalesce("component", "id").alias("component")),
        "named",
    )
    run.scratch.settle()
    out = run.signed.select("id", "n", "f1", "f2").join(named, ["f1", "f2", "n"], "left").select("id", "n", F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.col("component")).alias("component"))
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, and one of the rows that repeat its id and text."""
    scratch = Scratch(docs.sparkSession, "near")
    gone, key = unused("__gone", docs), unused("__key", docs)
    near = near_duplicates(docs, id_col, text_col, **how)
    dropped = scratch.keep(near.where("NOT kept").select(F.col(id_col).cast("long").alias(gone)).distinct(), "gone")
    keyed = docs.withColumn(key, F.col(id_col).cast("long"))
    may, others = among(keyed, [F.col(key)], dropped, scratch)
    left = others.unionByName(may.join(dropped, F.col(key) == F.col(gone), "left_anti"))
    repeated = scratch.keep(docs.groupBy(F.col(id_col).cast("long").alias(key)).count().where("count > 1").select(key), "repeated")
    if repeated.isEmpty():
        return left.drop(key)
    may, others = among(left, [F.col(key)], repeated, scratch)
    sha = unused("__sha", may)
    named = may.withColumn(sha, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    return others.unionByName(one_of(named, [key, sha], [], [text_col]).drop(sha)).drop(key)


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=3, percent=85)


QUERIES = {"op10_minhash": op10_minhash}
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE_SQL = {
    "op10_minhash": rf"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS ws FROM documents
        ), s AS (
            SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
                   ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) END) AS sh FROM w
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY ALL),
        c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_ FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY ALL),
        e AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * both_ >= 85 * (na.n + nb.n - both_)),
        r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
        SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.root) AS component_id, d.doc_id = min(r.root) AS kept
        FROM documents d JOIN r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id
    """
}

"""Mixing sources to target weights, with DataFrame functions only.

Temperature mixing: a source's weight is its token share to the power of an
exponent in [0, 1], normalised (1 keeps the natural shares, 0 makes them
equal).  The exponent is the largest whose weights reach ``entropy`` of the
greatest entropy, raised as far as needed that no source repeats more than
``repeats`` times; both limits are met by bisection, four halvings in each
aggregation over the table of sources.

The budget is realised by block permutations.  A source's documents are hashed
into blocks of about ``block_tokens`` tokens, as many as it takes; every pass
permutes the blocks by a hash of block and pass, and documents in a block
likewise.  Whole passes take every document; the last takes blocks while they
fit, and from the one block at the limit the documents that fit.  Running sums
over a source's blocks are taken in two levels, over ``_RANGES`` ranges of the
permuting hash and then inside each range, so no task sorts a source.

Defined results: a null source is a source of its own; a null or blank text has
no tokens, and is taken in whole passes only (so sources without any token have
no rows); a null id is dealt with like any other value; rows that repeat an id
are separate documents of the same rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.plans.pruning import quoted, unused
from weftline.plans.scratch import Scratch

ENTROPY = 0.98
REPEATS = 4.0
BLOCK_TOKENS = 4096
#: The permuting hash has 32 bits; its first 12 name a range.
_RANGES, _RANGE_BITS = 1 << 12, 20
#: Rows of chosen blocks up to which they are broadcast to the documents, about 250 bytes each; beyond that the documents are shuffled to them.
MOST_BROADCAST = 400_000
#: Halvings of the exponent's range: 4 in each of 10 aggregations.
_STEPS, _PARTS = 10, 16
#: Tokens by which rounding may have put a quota below a whole number.
_SLACK = 0.001


def tokens(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def _hash(*parts: Column | int | str) -> Column:
    """A hash in [0, 2**32) that any SQL engine can compute: eight digits of an MD5."""
    text = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def exponent(sources: DataFrame, budget: float, entropy: float, repeats: float) -> float:
    """The exponent for these sources (columns n: tokens, p: share)."""
    size = sources.agg(F.count(F.lit(1))).first()[0]
    if size < 2:
        return 1.0

    def largest(fits) -> float:
        """The largest exponent in [0, 1] that fits, where all below one that fits do."""
        lo, hi = 0.0, 1.0
        for step in range(_STEPS):
            at = [lo + (hi - lo) * i / _PARTS for i in range(1, _PARTS + (step == 0))]
            ok = fits(at)
            n = len(ok) if all(ok) else ok.index(False)
            if n == len(at) and step == 0:
                return 1.0
            width = (hi - lo) / _PARTS
            lo = at[n - 1] if n else lo
            hi = lo + width
        return lo

    def entropies(at: list[float]) -> list[bool]:
        z = [F.sum(F.pow("p", F.lit(a))) for a in at]
        s = [F.sum(F.pow("p", F.lit(a)) * F.lit(a) * F.log("p")) for a in at]
        row = sources.agg(*(F.log(x) - y / x for x, y in zip(z, s, strict=True))).first()
        top = sources.agg(F.log(F.count(F.lit(1)))).first()[0]
        return [v >= entropy * top for v in row]

    def repeated(at: list[float]) -> list[bool]:
        """For exponents counted down from 1: whether some source repeats too often."""
        row = sources.agg(*(F.max(budget * F.pow("p", F.lit(1 - a)) / F.col("n")) / F.sum(F.pow("p", F.lit(1 - a))) for a in at)).first()
        return [v <= repeats for v in row]

    by_entropy = largest(entropies)
    by_repeats = 1 - largest(repeated)
    return max(by_entropy, by_repeats)


def source_weights(docs: DataFrame, source_col: str = "source", text_col: str = "text", *, budget: float | None = None, entropy: float = ENTROPY, repeats: float = REPEATS, block_tokens: int = BLOCK_TOKENS, scratch: Scratch | None = None) -> DataFrame:
    """One row per source with tokens: source, n, p, weight, quota, passes, rest, blocks."""
    scratch = scratch or Scratch(docs.sparkSession, "mix")
    return weights_of(docs.select(F.col(source_col).alias("source"), tokens(F.col(text_col)).alias("t")), scratch, budget=budget, entropy=entropy, repeats=repeats, block_tokens=block_tokens)


def weights_of(rows: DataFrame, scratch: Scratch, *, budget: float | None = None, entropy: float = ENTROPY, repeats: float = REPEATS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``source_weights`` of rows of source and t, their numbers of tokens."""
    counted = scratch.keep(rows.groupBy("source").agg(F.sum("t").alias("n")).where("n > 0"), "sources")
    total = counted.agg(F.sum("n")).first()[0] or 0
    budget = float(total if budget is None else budget)
    shares = counted.withColumn("p", F.col("n") / F.lit(float(max(total, 1))))
    power = F.pow("p", F.lit(exponent(shares, budget, entropy, repeats)))
    sums = shares.agg(F.sum(power).alias("z"))
    out = shares.crossJoin(F.broadcast(sums)).withColumn("weight", power / F.col("z"))  # one row
    out = out.withColumn("quota", F.floor(F.col("weight") * budget + _SLACK).cast("long"))
    passes = F.floor(F.col("quota") / F.col("n")).cast("long")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / block_tokens)).cast("long")
    return scratch.keep(out.select("source", "n", "p", "weight", "quota", passes.alias("passes"), (F.col("quota") - passes * F.col("n")).alias("rest"), blocks.alias("blocks")), "weights")


def _same(a: DataFrame, b: DataFrame, *names: str) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & a[n].eqNullSafe(b[n])
    return out


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", *, seed: int = 17, **how) -> DataFrame:
    """The mixture: one row for each time a document is taken.

    The documents' columns, and n_tokens, weight, pass (from 0), block, mix_pos,
    in place of any columns of those names.  Sorting by ``mix_pos``, a block's
    place in its source's quota, interleaves the sources by weight.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    # Texts are split twice: here, into a narrow table, and where a document is taken.
    rows = scratch.keep(docs.select(F.col(source_col).alias("source"), _hash(seed, F.col(id_col)).alias("h"), tokens(F.col(text_col)).alias("t")), "tokens")
    weights = weights_of(rows, scratch, **how)
    made = ["n_tokens", "weight", "pass", "block", "mix_pos"]
    docs = docs.drop(*made)
    w = weights.withColumnRenamed("source", "s")
    # Sources are a dimension table: some hundreds of rows at most in practice; the optimizer broadcasts it by its size.
    rows = rows.withColumnRenamed("source", "src")
    dealt = rows.join(w.select("s", "blocks"), rows.src.eqNullSafe(w.s)).select("src", "t", F.pmod("h", "blocks").alias("block"))
    sums = dealt.groupBy("src", "block").agg(F.sum("t").alias("bt"))
    sums = scratch.keep(w.join(sums, w.s.eqNullSafe(sums.src)).select("src", "block", "bt", "weight", "quota", "n", "passes", "rest"), "sums")
    each = sums.withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes")))).withColumn("h", _hash(seed, "block", F.col("block"), F.col("pass"))).withColumn("range", F.shiftright("h", _RANGE_BITS))
    ranges = each.groupBy("src", "pass", "range").agg(F.sum("bt").alias("rt"))
    ranges = ranges.select(F.col("src").alias("rs"), F.col("pass").alias("rp"), F.col("range").alias("rr"), (F.sum("rt").over(W.partitionBy("src", "pass").orderBy("range")) - F.col("rt")).alias("base"))  # _RANGES rows of a source and pass
    each = each.join(ranges, F.col("src").eqNullSafe(F.col("rs")) & (F.col("pass") == F.col("rp")) & (F.col("range") == F.col("rr")))
    order = W.partitionBy("src", "pass", "range").orderBy("h", "block")
    each = each.withColumn("until", F.col("base") + F.sum("bt").over(order)).withColumn("before", F.col("until") - F.col("bt"))
    last = F.col("pass") == F.col("passes")
    each = each.where(~last | (F.col("before") < F.col("rest")))
    place = (F.col("pass") * F.col("n") + F.col("before")) / F.greatest("quota", F.lit(1))
    each = scratch.keep(
        each.select(F.col("src").alias("s"), F.col("block").alias("b"), "weight", F.col("pass").alias("p"), place.alias("place"), F.when(last & (F.col("until") > F.col("rest")), F.col("rest") - F.col("before")).alias("room")),
        "blocks",
    )
    own = {n: unused(n, docs, each) for n in ("__source", "__tokens", "__block", "__blocks")}
    source, t, block, blocks = own.values()
    w = w.select(F.col("s").alias(source), F.col("blocks").alias(blocks))
    placed = docs.join(w, F.col(source_col).eqNullSafe(F.col(source))).withColumns({block: F.pmod(_hash(seed, F.col(id_col)), F.col(blocks))})
    taking = each if each.count() > MOST_BROADCAST else F.broadcast(each)
    at = {c: unused(f"__{c}", placed) for c in each.columns}
    taking = taking.withColumnsRenamed(at)
    s, b, weight, p, place, room = (F.col(at[c]) for c in ("s", "b", "weight", "p", "place", "room"))
    taken = placed.join(taking, F.col(source).eqNullSafe(s) & (F.col(block) == b))
    whole, limit = (rows.withColumn(t, tokens(F.col(text_col))) for rows in (taken.where(room.isNull()), taken.where(room.isNotNull())))
    # The documents of the block at the limit: one block of a source, of about block_tokens tokens or one document.
    inner = W.partitionBy(source, block, p).orderBy(_hash(seed, "doc", F.col(id_col), p), F.col(id_col))
    upto = unused("__upto", limit)
    part = limit.withColumn(upto, F.sum(t).over(inner.rangeBetween(W.unboundedPreceding, 0))).where((F.col(upto) <= room) & (F.col(t) > 0)).drop(upto)
    out = whole.unionByName(part)
    return out.select(*quoted(*docs.columns), F.col(t).alias("n_tokens"), F.round(weight, 9).alias("weight"), p.cast("long").alias("pass"), F.col(block).alias("block"), F.round(place, 9).alias("mix_pos"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    return out.select("doc_id", "source", "n_tokens", "weight", "pass", "block", "mix_pos")


QUERIES = {"op1_mixing": op1_mixing}


def _md5(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT"


_ID = "coalesce(doc_id::VARCHAR, '')"
ORACLE_SQL = {
    "op1_mixing": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS t FROM documents),
        s AS (SELECT source, sum(t)::BIGINT AS n FROM d GROUP BY source HAVING sum(t) > 0),
        tot AS (SELECT sum(n)::DOUBLE AS total, ln(count(*)) AS top FROM s),
        p AS (SELECT source, n, n / total AS p, total, top FROM s, tot),
        e AS (SELECT 0 AS step, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi UNION ALL
              SELECT step + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END
              FROM (SELECT step, lo, hi, (lo + hi) / 2 AS mid,
                    (SELECT ln(sum(p ** ((lo + hi) / 2))) - sum(p ** ((lo + hi) / 2) * (lo + hi) / 2 * ln(p)) / sum(p ** ((lo + hi) / 2)) >= {ENTROPY} * any_value(top) FROM p) AS ok
                    FROM e WHERE step < 40)),
        g AS (SELECT 0 AS step, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi UNION ALL
              SELECT step + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END
              FROM (SELECT step, lo, hi, (lo + hi) / 2 AS mid,
                    (SELECT max(total * p ** (1 - (lo + hi) / 2) / n) / sum(p ** (1 - (lo + hi) / 2)) <= {REPEATS} FROM p) AS ok
                    FROM g WHERE step < 40)),
        a AS (SELECT greatest((SELECT lo FROM e WHERE step = 40), (SELECT 1 - hi FROM g WHERE step = 40)) AS a,
                     (SELECT ln(sum(p)) - sum(p * ln(p)) / sum(p) >= {ENTROPY} * any_value(top) FROM p) AS nat),
        w AS (SELECT source, n, p ** (CASE WHEN nat THEN 1 ELSE a END) / sum(p ** (CASE WHEN nat THEN 1 ELSE a END)) OVER () AS weight, total FROM p, a),
        q AS (SELECT source, n, weight, floor(weight * total + {_SLACK})::BIGINT AS quota FROM w),
        v AS (SELECT *, quota // n AS passes, quota - quota // n * n AS rest, greatest(1, ceil(n / {BLOCK_TOKENS}))::BIGINT AS blocks FROM q),
        r AS (SELECT doc_id, d.source, t, {_md5("'17'", _ID)} % blocks AS block FROM d JOIN v ON d.source IS NOT DISTINCT FROM v.source),
        b AS (SELECT source, block, sum(t)::BIGINT AS bt FROM r GROUP BY ALL),
        x AS (SELECT b.*, v.weight, v.quota, v.n, v.passes, v.rest, unnest(range(0, v.passes + 1)) AS pass FROM b JOIN v ON b.source IS NOT DISTINCT FROM v.source),
        y AS (SELECT *, (sum(bt) OVER (PARTITION BY source, pass ORDER BY {_md5("'17'", "'block'", "block::VARCHAR", "pass::VARCHAR")}, block))::BIGINT AS until FROM x),
        z AS (SELECT source, block, weight, pass, (pass * n + until - bt) / greatest(quota, 1) AS mix_pos,
                     CASE WHEN pass = passes AND until > rest THEN rest - until + bt END AS room
              FROM y WHERE pass < passes OR until - bt < rest),
        k AS (SELECT doc_id, r.source, t, r.block, weight, pass, mix_pos, room,
                     sum(t) OVER (PARTITION BY r.source, r.block, pass ORDER BY {_md5("'17'", "'doc'", _ID, "pass::VARCHAR")}, doc_id) AS upto
              FROM r JOIN z ON r.source IS NOT DISTINCT FROM z.source AND r.block = z.block)
        SELECT doc_id, source, t AS n_tokens, round(weight, 9) AS weight, pass, block, round(mix_pos, 9) AS mix_pos
        FROM k WHERE room IS NULL OR (upto <= room AND t > 0)
    """
}

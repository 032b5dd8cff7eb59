"""Operators against brute-force versions on small tables, and cases that the driver's tables lack."""

import itertools
import math
import random
import re

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.operators import candidates as C
from weftline.operators import graphs as G
from weftline.operators import meeting as ME
from weftline.operators import models as M
from weftline.operators import outlets as O
from weftline.operators import stats as ST
from weftline.operators.pairs import shared_entity_pairs
from weftline.operators.together import together
from weftline.plans.pruning import among, unused
from weftline.plans.scratch import Scratch, discarded


def bags(seed, n=60, vocabulary=25, frequent=("hot",)):
    """Documents with entities, some of them in nearly all documents, and some sets that are alike."""
    rng = random.Random(seed)
    out = {}
    for i in range(n):
        own = {f"e{rng.randrange(vocabulary)}" for _ in range(rng.randrange(1, 9))} if i % 3 or not out else {*rng.choice(list(out.values()))[2]} | {f"x{rng.randrange(4)}"}
        out[i] = ("en" if rng.random() < 0.7 else "fr", rng.randrange(12), own | ({*frequent} if rng.random() < 0.9 else set()))
    return out


@pytest.mark.parametrize(("least", "same"), [(0.3, True), (0.2, False), (0.5, True), (1.0, True)])
def test_similar_pairs(spark, least, same):
    docs = bags(int(least * 10))
    rows = [(i, lang, day, e, 1) for i, (lang, day, own) in docs.items() for e in own]
    bag = spark.createDataFrame(rows, "doc_id long, lang string, day int, ne string, cnt long")
    got = {(r.doc1, r.doc2): r.both for r in C.similar_pairs(bag, least, Scratch(spark, "test"), same_language=same).collect()}
    want = {}
    for (a, (la, da, x)), (b, (lb, db, y)) in itertools.combinations(docs.items(), 2):
        if (la == lb) == same and abs(da - db) <= 5 and len(x & y) / len(x | y) >= least:
            want[a, b] = len(x & y)
    assert (want or least == 1.0) and got == want


def meetings(spark, seed, block, **asked):
    """Pairs of random documents that meet at their best entities, and of all pairs what they share by brute force."""
    rng = random.Random(seed)
    own = {i: (lang, day, {e: rng.randrange(1, 4) for e in words}) for i, (lang, day, words) in bags(seed, n=90).items()}
    bag = spark.createDataFrame([(i, lang, day, e, c) for i, (lang, day, v) in own.items() for e, c in v.items()], "doc_id long, lang string, day int, ne string, cnt long")
    scratch = Scratch(spark, "test")
    docs = ME.vectors(bag, spark.range(500), scratch, best=3, stop=1)
    meet = {r.doc_id: {*r.meets} for r in docs.collect()}
    found = ME.met(docs, F.col("meets"), ME.Meeting(**{"articles": 500, "mean": 7.0} | asked), scratch, block)
    want = {}
    for (a, (la, da, x)), (b, (lb, db, y)) in itertools.combinations(own.items(), 2):
        if abs(da - db) <= 5 and meet[a] & meet[b]:
            want[a, b] = (la, lb, x, y)
    return own, found, want


@pytest.mark.parametrize("block", [4096, 5])
def test_met_sums(spark, block):
    """Each pair once, also where an entity's documents are dealt in blocks, with sums over all that it shares."""
    own, found, want = meetings(spark, 3, block, sums=("same", "weight", "dot", "tfidf", "bm25"), beside=("lang",))
    got = found.collect()
    assert len(got) == len({(r.doc1, r.doc2) for r in got}) == len(want) > 50
    df = {e: sum(e in v for _, _, v in own.values()) for _, _, x in own.values() for e in x}
    for r in got:
        la, lb, x, y = want[r.doc1, r.doc2]
        both = x.keys() & y.keys()
        total = sum(x.values()) + sum(y.values())
        tf = {e: (x[e] + y[e]) / total for e in both}
        idf = {e: math.log(500 / (1 + df[e])) for e in both}
        assert (r.both, r.same, r.weight, r.dot, r.lang1, r.lang2) == (len(both), sum(x[e] == y[e] for e in both), sum(x[e] + y[e] for e in both), sum(x[e] * y[e] for e in both), la, lb)
        assert math.isclose(r.tfidf, sum(tf[e] * idf[e] for e in both))
        assert math.isclose(r.bm25, sum(idf[e] * tf[e] * 2.2 / (tf[e] + 1.2 * (0.25 + 0.75 * total / 2 / 7.0)) for e in both))


@pytest.mark.parametrize("block", [4096, 5])
def test_met_pairs_and_best(spark, block, monkeypatch):
    """Pairs alone; those alike enough; and each document's best, when tiles and what is held are small too."""
    for limits, ok in (({}, lambda *_: True), ({"alike": True, "same": 0.3, "other": 0.2}, lambda la, lb, j: j >= (0.3 if la == lb else 0.2)), ({"alike": True, "other": 0.2}, lambda la, lb, j: la != lb and j >= 0.2)):
        _, found, want = meetings(spark, 4, block, **limits)
        got = [(r.doc1, r.doc2) for r in found.collect()]
        assert sorted(got) == sorted(k for k, (la, lb, x, y) in want.items() if ok(la, lb, len(x.keys() & y.keys()) / len(x.keys() | y.keys())))
    _, found, want = meetings(spark, 4, block, best=2)
    rank = F.row_number().over(W.partitionBy("doc").orderBy(F.desc(F.col("both") / (F.col("n1") + F.col("n2") - F.col("both"))), "other"))
    ways = [(d, o, len(x.keys() & y.keys()) / len(x.keys() | y.keys())) for (a, b), (_, _, x, y) in want.items() for d, o in ((a, b), (b, a))]
    best = {d: [o for _, o in sorted((-j, o) for e, o, j in ways if e == d)[:2]] for d, _, _ in ways}
    got = {}
    for r in found.withColumn("rank", rank).where("rank <= 2").orderBy("doc", "rank").collect():
        got.setdefault(r.doc, []).append(r.other)
    assert got == best


def test_met_tiles():
    """A group of more documents than a tile has, and best ones of more than are held at once."""
    n, of = 2500, ME.Meeting(sums=("both",))
    lists = lambda: pa.array([[7, 9 + i % 3] for i in range(n)], pa.list_(pa.int32()))
    t = {"doc_id": pa.array(range(n)), "lang": pa.array(["en"] * n), "tongue": pa.array([""] * n), "ids": lists(), "cnts": lists(), "meets": lists()}
    t |= {k: pa.array([v] * n, pa.int32()) for k, v in (("key", 7), ("bucket", 0), ("part", 0), ("own", 0), ("day", 3), ("role", 3), ("n", 2))}
    rows = pa.RecordBatch.from_pydict(t)
    cut = [rows.slice(i, 700) for i in range(0, n, 700)]
    assert sum(b.num_rows for b in of(iter(cut))) == n * (n - 1) // 2
    best = [x for b in ME.Meeting(best=1, beside=("n",))(iter(cut)) for x in zip(b["doc"].to_pylist(), b["other"].to_pylist(), b["both"].to_pylist(), strict=True)]
    assert {(d, o) for d, o, both in best if both == 2} >= {(d, 0 if d % 3 == 0 and d else d % 3 if d > 2 else d + 3) for d in range(n)} and len(best) < 3 * n


def test_together(spark):
    """Words in common with repeats and without, and long sentences, of pairs that meet at several places."""
    rng = random.Random(5)
    long = ["this is a long sentence that some of the texts have.", "and here is another long one of more than forty characters."]
    texts = {i: " ".join(rng.choice("abcdefg") for _ in range(rng.randrange(0, 20))) + (". " + rng.choice(long) if i % 4 == 0 else "") for i in range(30)} | {30: None, 31: ""}
    docs = spark.createDataFrame([(i, t, "en") for i, t in texts.items()], "doc_id long, text string, lang string")
    rows = [(a, b, rng.randrange(3), 0, rng.randrange(2), f"x{a}") for a, b in itertools.combinations(texts, 2) if rng.random() < 0.4]
    scratch = Scratch(spark, "test")
    pairs = scratch.keep(spark.createDataFrame(rows, "doc1 long, doc2 long, key int, bucket int, part int, x string"), "pairs")
    token = lambda t: re.sub(r"[^\w ]", "", t or "").split(" ")
    said = lambda t: {s.strip() for s in (t or "").split(".") if len(s) > 40}
    for given in (pairs, scratch.keep(pairs.drop(*ME.PLACE), "bare")):
        got = {(r.doc1, r.doc2): r for r in together(given, docs, scratch, sentences=True).collect()}
        assert got.keys() == {x[:2] for x in rows}
        for (a, b), r in got.items():
            x, y = (Counter(token(texts[k])) for k in (a, b))
            assert (r.common, r.kinds, r.size1, r.size2, r.kinds1, r.kinds2, r.sentence, r.x) == ((x & y).total(), len(x & y), x.total(), y.total(), len(x), len(y), bool(said(texts[a]) & said(texts[b])), f"x{a}")


def test_best_candidates(spark):
    found = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.5), (2, 3, 0.9)], "doc1 long, doc2 long, jaccard double")
    assert {(r.doc, r.other) for r in C.best_candidates(found, 1).collect()} == {(1, 2), (2, 3), (3, 2)}


def test_refinement(spark):
    """A pair that passes every condition, and one that fails each."""
    long = lambda i: " ".join(f"w{i}x{j}" for j in range(120))
    sentence = "this is one long sentence that two articles have in common. "
    texts = {1: long(1), 2: long(2), 3: "short", 4: sentence + "same " * 110, 5: sentence + "same " * 112, 6: sentence + long(6), 7: sentence + long(7)}
    docs = spark.createDataFrame([(i, t, "en") for i, t in texts.items()], "doc_id long, text string, lang string")
    scratch = Scratch(spark, "test")
    rows = [(1, 2, "en", "en", 5, 2.0), (1, 2 + 4, "en", "en", 4, 2.0), (2, 6, "en", "en", 5, 1.2), (1, 3, "en", "en", 5, 2.0), (4, 5, "en", "en", 5, 2.0), (6, 7, "en", "en", 5, 1.25), (4, 6, "en", "fr", 9, None)]
    pairs = scratch.keep(spark.createDataFrame([r[:5] for r in rows], "doc1 long, doc2 long, lang1 string, lang2 string, both long"), "pairs")
    shared = spark.createDataFrame([(r[0], r[1], r[5]) for r in rows if r[5]], "doc1 long, doc2 long, shared double")
    got = {(r.doc1, r.doc2): (r.enough, r.weighty, r.long, r.dup, r.kept) for r in C.judged(pairs, docs, shared, scratch).collect()}
    yes = (True, True, True, False, True)
    assert got == {(1, 2): yes, (1, 6): (False, True, True, False, False), (2, 6): (True, False, True, False, False), (1, 3): (True, True, False, False, False), (4, 5): (True, True, True, True, False), (6, 7): yes, (4, 6): (True, False, True, False, False)}


def test_contained(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("ab.c") for _ in range(n))
    texts, names = [word(rng.randrange(0, 12)) for _ in range(80)] + [None], [word(rng.randrange(0, 6)) for _ in range(40)] + [None]
    frames = [spark.createDataFrame([(x,) for x in v], "v string") for v in (texts, names)]
    got = {(r.text, r.name) for r in O.contained(frames[0], "v", frames[1], "v").collect()}
    assert got == {(t, n) for t in texts for n in names if t and n and n in t}


def test_outlets_broadcast_nothing_that_grows(spark):
    """Neither outlets nor what they meet are sent to all executors through the driver, as many as the input has of them."""
    urls = spark.createDataFrame([(i, f"host{i}.org/{i}") for i in range(50)], "k long, u string")
    names = spark.createDataFrame([(f"host{i}", i) for i in range(40)], "name string, first long")
    frames = [O.contained(urls, "u", names, "name"), O.matched(urls, "k", "u", names, "name", ["first"]), O.flagged(urls, "k", "u", [("A-", names), ("B-", names)], "name", ["first"])]
    assert [f.count() for f in frames] == [sum(f"host{j}" in f"host{i}.org/{i}" for i in range(50) for j in range(40)), 50, 50]
    plans = [f._jdf.queryExecution().optimizedPlan().toString() for f in frames]
    joins = [[line for line in plan.splitlines() if "Join" in line] for plan in plans]
    assert all("strategy=merge" in line for lines in (joins[0][:1], *joins[1:]) for line in lines) and all(joins)  # grams are few: those of all names are met as Spark sees fit


def test_flags_and_last_wins(spark):
    urls = spark.createDataFrame([(1, "a.com/x"), (2, "b.org"), (3, "zzz"), (4, "c")], "k long, u string")
    one, two = (spark.createDataFrame(rows, "name string, first long") for rows in ([("a.com", 2), ("com", 1)], [("b", 1), ("abc", 2)]))
    got = {(r.k, r.flag, r.outlet1, r.outlet2) for r in O.flagged(urls, "k", "u", [("A-", one), ("B-", two)], "name", ["first"]).collect()}
    assert got == {(1, "A-", "com", None), (2, "B-", None, "b"), (4, "A-B-", "com", "abc")}
    rows = spark.createDataFrame([("k", 1, "first"), ("k", 3, "last"), ("k", 2, None), ("m", 1, None)], "key string, at long, v string")
    assert {(r.key, r.v) for r in O.last_wins(rows, ["key"], "at").collect()} == {("k", "last"), ("m", None)}


def test_p_values(spark):
    """Known values: r = 0.5 of 10 pairs, none, a perfect one, and many pairs."""
    rows = spark.createDataFrame([(0.5, 10), (0.0, 10), (1.0, 10), (-0.5, 10), (0.01, 100_000), (0.3, 2)], "r double, n long")
    got = {(r.r, r.n): r.p for r in ST.with_p_value(rows).collect()}
    assert got[0.5, 10] == pytest.approx(0.1411, abs=1e-4) and got[-0.5, 10] == got[0.5, 10]
    assert got[0.0, 10] == pytest.approx(1) and got[1.0, 10] == 0 and got[0.3, 2] is None
    assert got[0.01, 100_000] == pytest.approx(math.erfc(0.01 * math.sqrt((100_000 - 2) / (1 - 1e-4)) / math.sqrt(2)), abs=1e-5)


def test_ranks_without_groups(spark):
    rng = random.Random(4)
    values = [rng.randrange(30) for _ in range(200)]
    rows = spark.createDataFrame([(v,) for v in values], "v long").repartition(5)
    got = {r.v: r.v_rank for r in ST.average_ranks(rows, "v", []).collect()}
    assert got == {v: sum(x < v for x in values) + (sum(x == v for x in values) + 1) / 2 for v in set(values)}


def test_small_graphs(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 4, 1.0), (4, 5, 1.0)], "c1 long, c2 long, weight double")
    assert {r.c: round(r.betweenness * 12, 9) for r in G.betweenness(edges).collect()} == {1: 0, 2: 6, 3: 8, 4: 6, 5: 0}
    two = spark.createDataFrame([(a, b, 1.0) for k in (0, 10) for a, b in itertools.combinations(range(k, k + 4), 2)] + [(3, 10, 0.5)], "c1 long, c2 long, weight double")
    assert {r.c: r.community for r in G.greedy_modularity(two).collect()} == {**dict.fromkeys(range(4), 0), **dict.fromkeys(range(10, 14), 10)}
    assert G.greedy_modularity(two.limit(0)).count() == G.betweenness(two.limit(0)).count() == 0


def test_regression(spark):
    """Coefficients, R2, adjusted R2 and AIC against normal equations."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 2))
    y = 1 + x @ [2.0, -3.0] + rng.normal(size=60)
    rows = M.ols(spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y double"), ["a", "b"], "y").collect()
    design = np.column_stack([x, np.ones(60)])
    w = np.linalg.lstsq(design, y, rcond=None)[0]
    rss, tss = ((y - design @ w) ** 2).sum(), ((y - y.mean()) ** 2).sum()
    assert [r.coefficient for r in rows] == pytest.approx(list(w), abs=1e-8)
    assert rows[0].r2 == pytest.approx(1 - rss / tss) and rows[0].r2_adjusted == pytest.approx(1 - rss / 57 / (tss / 59))
    assert rows[0].aic == pytest.approx(60 * math.log(2 * math.pi * rss / 60) + 60 + 6)


def test_translation_ratio(spark):
    """110 tokens are enough in French; as floats, 100 * 1.1 is a little more."""
    rows = spark.createDataFrame([("fr", 110), ("fr", 109), ("de", 87), ("de", 86), ("xx", 100), (None, 99)], "lang string, n int")
    long = lambda compat: [tuple(r) for r in rows.where(F.col("n") >= X.MIN_TOKENS * X.translation_ratio(F.col("lang"), compat)).collect()]
    assert long(False) == [("fr", 110), ("de", 87), ("xx", 100)] and long(True) == [("de", 87), ("xx", 100)]


@pytest.mark.parametrize("n", [0, 1, 3000, 60_000])
def test_among(spark, n):
    """No key is lost, whatever the number of keys; rows are dealt in two."""
    scratch = Scratch(spark, "test")
    rows = spark.range(40_000).select(F.when(F.col("id") > 0, F.col("id")).alias("k"), F.lit("x").alias("__bits"), F.lit("y").alias("a.b"))
    keys = scratch.keep(spark.range(n).select(F.when(F.col("id") > 0, F.col("id") * 2).alias("key")), "keys")
    may, others = among(rows, [F.col("k")], keys, scratch)
    assert may.columns == rows.columns and may.count() + others.count() == 40_000
    assert others.join(keys, F.col("k").eqNullSafe(F.col("key"))).count() == 0
    if 0 < n <= 3000:
        assert may.count() < n + 4000


def test_unused(spark):
    df = spark.createDataFrame([(1, 2)], "`__a` int, `___A` int")
    assert unused("__a", df) == "____a" and unused("b", df) == "b"


def test_scratch_is_dropped(spark, tmp_path):
    import os

    scratch = Scratch(spark, "dropped")
    kept = scratch.keep(spark.range(3), "numbers")
    folder = scratch.root.removeprefix("file://")
    assert kept.count() == 3 and os.listdir(folder)
    scratch.drop(kept)
    assert not os.listdir(folder)
    with discarded():
        inner = Scratch(spark, "inner")
        again = scratch.keep(inner.keep(spark.range(3), "numbers"), "again")
    assert again.count() == 3 and os.path.isdir(folder) and not os.path.exists(inner.root.removeprefix("file://"))


def test_pairs_without_window(spark):
    rows = spark.createDataFrame([(1, "e", 1), (2, "e", 30), (3, "f", 1)], "doc_id long, ne string, day int")
    assert {tuple(r) for r in shared_entity_pairs(rows, 40).collect()} == {(1, 2)}


def test_selected_features(spark):
    """Greedy selection by AIC, step by step with least squares; a feature that others explain is left out."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 3))
    x = np.column_stack([x, x[:, 0] + x[:, 1] + 0.01 * rng.normal(size=80)])
    y = 2 * x[:, 0] - x[:, 1] + 0.5 * rng.normal(size=80)
    names = ["a", "b", "c", "d"]
    chosen, path = M.select_features(spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], [*names, "y"]), names, "y")

    def aic(at):
        design = np.column_stack([np.ones(80), *(x[:, i] for i in at)])
        rss = ((y - design @ np.linalg.lstsq(design, y, rcond=None)[0]) ** 2).sum()
        return 80 * np.log(rss / 80) + 2 * (len(at) + 1)

    want, left, steps = [], [0, 1, 2], [aic([])]
    while left and aic([*want, best := min(left, key=lambda i: aic([*want, i]))]) < steps[-1]:
        want.append(best)
        left.remove(best)
        steps.append(aic(want))
    assert chosen == [names[i] for i in want] and path == pytest.approx(steps, abs=1e-6)


def test_label_propagation(spark):
    """Three rounds by hand-written loops."""
    from collections import defaultdict

    from weftline.operators.network import label_propagation

    rng = random.Random(5)
    edges = sorted({tuple(sorted(rng.sample(range(14), 2))) for _ in range(25)})
    rows = [(a, b, float(1 + (a * b) % 4)) for a, b in edges]
    label = {v: v for e in edges for v in e}
    for _ in range(3):
        votes = defaultdict(lambda: defaultdict(float))
        for a, b, w in rows:
            votes[a][label[b]] += w
            votes[b][label[a]] += w
        label = {v: min(votes[v], key=lambda k: (-votes[v][k], k)) for v in label}
    got = {r.c: r.community for r in label_propagation(spark.createDataFrame(rows, "c1 long, c2 long, weight double")).collect()}
    assert got == label

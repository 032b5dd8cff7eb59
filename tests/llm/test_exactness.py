"""Models and searches against brute-force versions; rows that repeat, clash or are absent."""

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import brute_near, folder, table, words
from tests.parity import same
from weftline.llm import decontaminate, exact, mixing, near, pii, quality, secrets, substring, toxicity, warc
from weftline.llm import wordhash as wh
from weftline.llm.labels import remainder

ZONES = ["+1 (171) 555", "a@b.c", "10.0.0.1", "x (at) y.z", "4111 1111"]


def segmentations(n, longest):
    """All segmentations of n tokens: other text in single tokens, any kind else."""
    if n == 0:
        yield []
    for size in range(1, min(n, longest) + 1):
        for rest in segmentations(n - size, longest):
            for kind in range(-1 if size == 1 else 0, len(pii.KINDS)):
                yield [*rest, (n - size, kind, n)]


def cases():
    rng = random.Random(5)
    out = []
    for text in ZONES:
        limits = pii.tokens(text, 0, len(text))[:6]
        if limits[-1] != len(text):
            text = text[: limits[-1]]
        out.append((text, limits, rng.choice(list(segmentations(len(limits) - 1, pii.LONGEST)))))
    return out


@pytest.fixture(scope="module")
def some_model():
    likelihood = pii.Likelihood(cases())
    x = np.random.default_rng(3).normal(size=sum(int(np.prod(s)) for s in likelihood.sizes()))
    weight, other, move = likelihood.unpack(x)
    named = {f"{k}|{f}": weight[i, k] for i, f in enumerate(likelihood.names) for k in range(4)}
    named |= {f"o|{c}": v for c, v in zip(likelihood.shapes, other, strict=True)}
    named |= {f"{a - 1}>{b - 1}": move[a, b] for a in range(5) for b in range(5)}
    return likelihood, x, pii.SemiMarkov(named)


def test_crf_sums_and_decodes(some_model):
    """Partition sum and decoder equal brute force over all segmentations."""
    likelihood, x, model = some_model
    ordered = sorted(cases(), key=lambda c: (-len(c[1]), c))
    for (text, limits, _), total in zip(ordered, likelihood.partition(x)[0], strict=True):
        scores = {tuple(s): model.score(text, limits, s) for s in segmentations(len(limits) - 1, pii.LONGEST)}
        assert total == pytest.approx(math.log(sum(math.exp(v) for v in scores.values())), abs=1e-9)
        assert scores[tuple(model.decode(text, limits))] == pytest.approx(max(scores.values()), abs=1e-9)


def test_crf_gradient(some_model):
    likelihood, x, _ = some_model
    value, gradient = likelihood.loss(x, 0.3)
    for i in np.random.default_rng(8).integers(0, len(x), 25):
        step = np.zeros(len(x))
        step[i] = 1e-5
        assert (likelihood.loss(x + step, 0.3)[0] - value) / 1e-5 == pytest.approx(gradient[i], abs=1e-3)


def test_crf_learns():
    text = "call +1 (171) 555-2028 or write jo.do@example.com or 10.0.0.1 now"
    model = pii.train([c for i in range(40) for c in pii.cases_of(text.replace("2028", str(2028 + i)))])
    for shown, kind in (("jo.do (at) example.com", 0), ("phone 1 (171) 555-2999", 3)):
        base, every = pii.find(f"write {shown} now", model)
        assert base == [] and [k for _, k, _ in every] == [kind]


def test_crf_trains_on_texts():
    """A text stands for its cases; one without zones, or none at all, adds nothing."""
    texts = ["write jo@example.com now", "nothing here", "call +1 (171) 555-2028 or 10.0.0.1", ""]
    own = [c for t in texts for c in pii.cases_of(t)]
    assert len(own) > 3 and pii.train(texts).weights == pii.train(own).weights == pii.train([texts[0], *own[len(list(pii.cases_of(texts[0]))):]]).weights != {}
    assert pii.train(["", "nothing here"]).weights == pii.train([]).weights == {}


@pytest.mark.parametrize("size", [3, 66, 90, 5000])
def test_pii_long_names(size):
    """An address of any length is one zone, from its first letter."""
    text = f"write {'a' * size} (at) example.com now"
    assert pii.zones(text) == [(6, len(text) - 4)]
    model = pii.train([c for i in range(40) for c in pii.cases_of(f"write {'jo' * (i + 1)}@example.com now")])
    assert [(s, k, e) for s, k, e in pii.find(text, model)[1]] == [(6, 0, len(text) - 4)]
    many = "a@" * 20_000
    assert pii.zones(many) == [(0, len(many))]


def test_pii_digests(spark):
    """Digests and spans derive from the very spans."""
    import hashlib

    texts = ["mail a@b.c", None, "", "call +1 (171) 555-2028 ü 10.0.0.1", "no data"]
    df = table(spark, [(i, t, "a") for i, t in enumerate(texts)])
    got = {r.doc_id: r for r in pii.find_personal_data(df).collect()}
    for i, t in enumerate(texts):
        base = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in pii.base_spans(t or ""))
        assert got[i].base == base and set(base.split(",")) <= {*got[i].spans.split(",")}
        assert pii.base_digest(t or "") == hashlib.sha256(base.encode()).hexdigest()
    assert pii.find_personal_data(df.limit(0)).count() == 0


def test_quality_brute_force():
    """Scores from loops over single cosines; ties at the last place all vote."""
    rng = random.Random(1)
    texts = [words(i, rng.randrange(1, 40)) for i in range(30)]
    tf = quality.counts(pa.array(texts))
    idf = np.full(quality.BUCKETS, 1.0, np.float32)
    basis = np.random.default_rng(2).standard_normal((quality.BUCKETS, 6)).astype(np.float32)
    space = quality.Space(idf, np.zeros(quality.BUCKETS, np.float32), basis, np.zeros((0, 6)), np.zeros(0), 0.4, np.zeros(0))
    z = space.latent(tf)
    space.vectors, space.labels = np.concatenate([z[:20], z[:5]]), np.array([i % 2 for i in range(25)], np.float32)  # five vectors twice
    space.weight = np.where(space.labels > 0, 1.5, 1.0).astype(np.float32)
    got = space.scores(pa.array([*texts, "", None]), 5)
    for i, text in enumerate(texts):
        near = [round(float(a), 6) for a in np.round(z[i] @ space.vectors.T, 6)]
        least = sorted(near, reverse=True)[4]
        votes = [(max(c, 1e-6) ** 2 * w, y) for c, w, y in zip(near, space.weight, space.labels, strict=True) if c >= least]
        assert got[i] == pytest.approx(sum(v * y for v, y in votes) / sum(v for v, _ in votes), abs=1e-4), text
    assert list(got[-2:]) == [0.4, 0.4]


def test_toxicity_brute_force():
    """Scores from loops over each text's own n-grams."""
    texts = ["Abc abcdefg", "ABCDEFGH", "", None, "x" * 40, "äöü äöü abc"]
    weight = np.random.default_rng(4).normal(size=toxicity.BUCKETS)
    model = toxicity.Model(weight, 0.25)
    got = model.scores(pa.array(texts))
    for i, text in enumerate(texts):
        raw, own = (text or "").encode(), set()
        for k in toxicity.ORDERS:
            for j in range(len(raw) - k + 1):
                one, _ = toxicity.grams(pa.array([raw[j : j + k]], pa.binary()), (k,))
                own.add(int(one[0][0]))
        assert got[i] == pytest.approx(1 / (1 + math.exp(-(0.25 + sum(weight[b] for b in own)))), abs=1e-9)


def test_toxicity_fit():
    """The fit's choice of buckets and its bound; a bucket that only one class has weighs for that class."""
    p, q = np.array([9.0, 0, 5, 30, 1]), np.array([0.0, 9, 5, 2, 0])
    assert list(toxicity.chosen(p, q, 40, 40, deviations=2.0)) == [0, 1, 3]
    assert list(toxicity.chosen(p, q, 40, 40, deviations=2.0, most=35)) == [3]
    bits = [np.packbits(np.array([i % 2, 1 - i % 2, 1], np.uint8)).tobytes() for i in range(40)]
    w, b = toxicity.fit(bits, np.array([i % 2 for i in range(40)]), np.array([1.0, -1.0, 0.1]), (20, 20))
    assert w[0] > 0.2 and w[1] < -0.2 and abs(w[2]) < 0.05 and abs(b) < 0.2


def test_substring_colliding_hashes(spark, tmp_path):
    """With six bits of each word hash nearly all words collide; results are the same, as windows are compared as words."""
    passage = words(1, 50, 10**6)
    rows = [(i, f"{words(10 + i, 60, 10**6)} {passage if i % 3 == 0 else words(90 + i, 50, 10**6)} {words(40 + i, 30, 10**6)}", "a") for i in range(12)]
    df = table(spark, rows)
    con = folder(df, tmp_path)
    out = substring.drop_repeats(df, bits=6)
    same(out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")), con, substring.ORACLE_SQL["op5_substring_dedup"])
    assert out.where("n_removed = 50").count() == 4


def test_symbols_agree_everywhere():
    """Equal passages get equal symbols in whatever batch and surroundings they are parsed."""
    from weftline.llm import recompress as rc

    passage = words(1, 60, 10**6)
    found = []
    for i in range(4):
        batch = wh.split(pa.array([f"{words(7 + i, 30 + i, 10**6)} {passage} {words(70 + i, 20, 10**6)}", words(i, 40)]), wh.RAW)
        s = rc.parse(batch.hash, batch.first, substring.ROUNDS, substring.LONGEST)
        inside = (s.low >= 30 + i) & (s.high <= 90 + i)
        found.append([(int(n), int(a) - i) for n, a in zip(s.name[inside], s.start[inside], strict=True)])
    assert len(found[0]) >= 4 and all(f == found[0] for f in found)


def test_substring_copies_share_anchors(spark, tmp_path):
    """Equal windows have anchors of one name at one place, also where they overlap; of each kind of repeat none is lost."""
    from weftline.llm import recompress as rc

    rng, rows = random.Random(5), []
    for i in range(40):
        period = " ".join(f"p{rng.randrange(10**6)}" for _ in range(rng.choice([1, 2, 5, 7, 20])))
        rows.append((i, f"{words(i % 9, rng.choice([34, 35, 36, 50]), 10**6)} {period} {period} {period} {words(50 + i, 20, 3)} {(period + ' ') * rng.choice([3, 10, 40])}", "a"))
    batch = wh.split(pa.array([t for _, t, _ in rows]), wh.RAW)
    s = rc.parse(batch.hash, batch.first, substring.ROUNDS, substring.LONGEST)
    anchor, last, seen = rc.anchors(s, batch.first, 35), np.repeat(batch.first[1:], batch.counts()), {}
    assert len(anchor) == len(batch.hash) and (anchor >= 0).mean() > 0.3
    for i, k in enumerate(anchor.tolist()):
        if i + 35 > last[i]:
            assert k < 0
        else:
            own = (int(s.name[k]), int(s.start[k]) - i) if k >= 0 else None
            assert seen.setdefault(batch.hash[i : i + 35].tobytes(), own) == own
    assert len(seen) < len(anchor) - 100
    con = folder(table(spark, rows), tmp_path)
    same(substring.op5_substring_dedup(spark, str(tmp_path)), con, substring.ORACLE_SQL["op5_substring_dedup"])


def test_substring_drops_shuffles_between_phases(spark, monkeypatch):
    """After each phase the shuffles that wrote its output are gone, so their files don't add up."""
    from weftline.plans.scratch import Scratch

    shuffles = lambda: spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
    last = lambda: max((int(str(k)) for k in str(shuffles().keys().mkString(" ")).split()), default=-1)
    left, settle = [], Scratch.settle

    def watched(self):
        settle(self)
        left.append(last() > before)

    monkeypatch.setattr(Scratch, "settle", watched)
    docs = table(spark, [(i, words(i % 7, 80), "a") for i in range(30)]).localCheckpoint()
    before = last()
    assert substring.drop_repeats(docs).where("n_removed = 80").count() == 30
    assert left == [False] * 3


def test_word_hashes_of_made_up_words():
    """Long words that share a polynomial modulo 2**64 whatever its base; the second polynomial tells them apart."""
    a = "a"
    for _ in range(11):
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    first = [int((wh._TABLE[d] * wh._power(wh._BASE, len(d))[: len(d)]).sum()) for d in (np.frombuffer(x.encode(), np.uint8) for x in (a, b))]
    h = wh.split(pa.array([f"{a} {b} {a}", f"x {b}"]), wh.RAW).hash
    assert first[0] == first[1] and h[0] != h[1] and h[0] == h[2] and h[1] == h[4]


def test_near_without_sketches(spark):
    """Without the sketches' limit the full sets decide alone."""
    rng = random.Random(3)
    base = words(20, 120).split()
    rows = []
    for i in range(40):
        own = list(base)
        for _ in range(rng.randrange(7)):
            own[rng.randrange(len(own))] = f"z{rng.randrange(9)}"
        rows.append((i, " ".join(own), "a"))
    assert near.sketch_limit(0.85, deviations=None) == near.BITS
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near.near_duplicates(table(spark, rows), shingle=3, percent=85, deviations=None).collect()}
    assert got == brute_near([(i, t) for i, t, _ in rows], 3, 85)


def test_word_shingles():
    assert near.word_shingles(" A\tb\nC \x0b d", 3) == {(b"a", b"b", b"c"), (b"b", b"c", b"d")}
    assert near.word_shingles("one Two", 3) == {(b"one", b"two")} and near.word_shingles(None, 3) == near.word_shingles(" \n", 3) == set()
    assert near.word_shingles("Ä é", 2) == {("Ä".encode(), "é".encode())}


@pytest.fixture(scope="module")
def clashing(spark):
    """Repeated rows, nulls, and columns named like the operators' own."""
    copy, item = words(1, 80), words(2, 40)
    rows = [(1, copy), (2, copy), (2, copy), (3, copy + " end"), (4, item), (4, item), (None, "alone"), (None, "alone"), (5, None), (6, ""), (7, words(9, 30))]
    names = ["__sha", "__keep", "__gone", "__bad", "__key", "__row", "__part", "n_tokens", "__source", "__s", "__room", "a.b"]
    return spark.createDataFrame([(i, t, "s", *range(len(names))) for i, t in rows], "doc_id long, text string, source string, " + ", ".join(f"`{n}` int" for n in names))


def ids(df):
    return sorted((r.doc_id is not None, r.doc_id or 0) for r in df.collect())


def test_drop_exact(clashing):
    out = exact.drop_exact(clashing)
    assert out.columns == clashing.columns
    assert ids(out) == [(False, 0), (True, 2), (True, 3), (True, 4), (True, 6), (True, 7)]


def test_drop_near(clashing):
    out = near.drop_near(clashing, shingle=5, percent=80)
    assert out.columns == clashing.columns
    assert ids(out) == [(False, 0), (True, 1), (True, 4), (True, 5), (True, 6), (True, 7)]


@pytest.mark.parametrize("limit", [1, 10**6])
def test_drop_contaminated(spark, clashing, limit):
    bench = spark.createDataFrame([(1, words(2, 40)), (2, None), (3, "")], "item_id long, text string")
    out = decontaminate.drop_contaminated(clashing, bench, least_items=1, block_windows=limit)
    assert out.columns == clashing.columns
    assert ids(out) == sorted(x for x in ids(clashing) if x != (True, 4))


def test_mix_carries_columns(spark, clashing, tmp_path):
    """All columns go along; beyond 1,024 blocks of a source nothing changes."""
    out = mixing.mix(clashing, block_tokens=8)
    assert set(clashing.columns) <= set(out.columns) and out.where("text IS NULL AND n_tokens > 0").isEmpty()
    rng = random.Random(6)
    rows = [(i, words(i, rng.randrange(0, 12)), "hot" if i % 4 else f"s{i % 8}") for i in range(3000)]
    df = table(spark, rows)
    con = folder(df, tmp_path)
    sql = mixing.ORACLE_SQL["op1_mixing"].replace(f"n / {mixing.BLOCK_TOKENS}", "n / 4")
    got = mixing.mix(df, block_tokens=4).select("doc_id", "source", "n_tokens", "weight", "pass", "block", "mix_pos")
    assert got.agg(F.max("block")).first()[0] > 1024
    same(got, con, sql)


def test_empty_tables(spark, clashing):
    none = clashing.limit(0)
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert all(f.count() == 0 for f in (exact.drop_exact(none), exact.mark_exact(none), near.drop_near(none), toxicity.drop_toxic(none, labels), mixing.mix(none), decontaminate.drop_contaminated(none, bench), substring.drop_repeats(none), secrets.scan(none)))
    assert decontaminate.drop_contaminated(clashing, bench).count() == clashing.count()
    assert toxicity.score(none, toxicity.train(none, labels, remainder("doc_id", 5) != 0)).count() == 0
    assert quality.score(none, quality.train(none, labels, remainder("doc_id", 4) != 2)).count() == 0


def test_warc_edges(spark, tmp_path):
    kind = "page_id long, url string, html string, digest string, first long"
    warc.write_archives(spark.createDataFrame([], kind), str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).count() == 0
    rows = [(1, "u", "<p>", "x", 1), (1, "v", "<p>", "x", 2), (2, "w", "<p>", None, None)]
    warc.write_archives(spark.createDataFrame(rows, kind), str(tmp_path / "some"))
    got = sorted((r.page_id, r.url, r.record_type, r.refers_to) for r in warc.read_archives(spark, str(tmp_path / "some")).collect())
    assert got == [(1, "u", "response", None), (1, "v", "response", None), (2, "w", "revisit", 1)]


def test_secrets_recall(spark):
    """Tokens that the tables' own writer planted, found by a rule of their own: all are secrets, and nearly nothing else is."""
    import re

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    planted = {(r.doc_id, m) for r in docs.where("text rlike '(?i)token = '").select("doc_id", "text").collect() for m in re.findall(r'(?i)token = "([0-9a-f]{40})"', r.text)}
    found = {(r.doc_id, r.candidate.lower()): r.is_secret for r in secrets.scan(docs).collect()}
    hit = {k for k, v in found.items() if v}
    planted = {(i, t.lower()) for i, t in planted}
    assert len(planted) > 50 and len(planted & hit) / len(planted) >= 0.95
    assert len(hit - planted) <= 0.1 * len(hit)


def brute_pipeline(rows, bench, toxic):
    """The deciding stages, by loops: ids that are left."""
    left = [(i, t) for i, t in rows if i not in toxic]
    last = {t or "": i for i, t in sorted(left, key=lambda r: r[0])}
    left = [(i, t) for i, t in left if last[t or ""] == i]
    near_ids = brute_near(left, 5, 80)
    left = [(i, t) for i, t in left if near_ids[i][1] == i]
    windows = set()
    for text in bench:
        ws = text.lower().split()
        windows |= {tuple(ws[j : j + 8]) for j in range(max(1, len(ws) - 7))}
    return [i for i, t in left if not any(tuple((t or "").lower().split()[j : j + len(w)]) == w for w in windows for j in range(len((t or "").split())))]


def test_pipeline_stages(spark, tmp_path):
    """Each stage's decisions take effect, and all columns stay."""
    import corpus_pipeline

    item, copy = words(2, 30), words(3, 100)
    rows = [(i, words(100 + i, 60), f"s{i % 3}") for i in range(40)]
    rows += [(50, copy, "s0"), (51, copy, "s1"), (52, copy + " tail", "s1"), (53, f"{words(7, 20)} {item} {words(8, 20)}", "s2"), (54, None, "s2"), (55, "", "s2")]
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    want = brute_pipeline([(i, t) for i, t, _ in rows], [item], set())
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns, name
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert sorted(r.doc_id for r in docs.select("doc_id").collect()) == sorted(want)
    out = corpus_pipeline.run(spark, str(tmp_path))
    text = {i: t for i, t, _ in rows}
    assert set(columns) <= set(out.columns)
    assert all(r.doc_id in want and text[r.doc_id] == r.text for r in out.select("doc_id", "text").collect())
    assert list(itertools.islice((n for n, _ in corpus_pipeline.STAGES), 5)) == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "mixing"]

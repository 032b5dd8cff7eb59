"""Edge cases, and brute-force versions on small tables."""

import gzip
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.parity import same
from weftline.llm import decontaminate, exact, mixing, near, pii, quality, secrets, substring, toxicity, warc
from weftline.llm.labels import remainder

DOCS = "doc_id long, text string, lang string, source string, n_chars long, length string, id string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None, "x", "y") for i, t, s in rows], DOCS)


def words(seed, n, size=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, copies, near copies, repeated rows, shared passages."""
    passage = words(1, 60)
    rows = [(1, None, "a"), (2, "", "a"), (3, "  \n", None), (4, "one", "a"), (5, "one two", "b"), (6, "one two", "b"), (6, "one two", "b"), (None, "one two", "b"), (None, None, None)]
    rows += [(10 + i, words(2, 200) + f" end{i}", "a") for i in range(12)]
    rows += [(30, words(3, 50) + " " + passage + " " + words(4, 50), "a"), (31, passage, "c"), (32, words(5, 20) + " " + passage, "c")]
    rows += [(40, "a " * 200, "a"), (41, "x y " * 60, "b"), (42, words(6, 30000, 10**6), "hot"), (43, "Ä\x00ß 1.2.3.4 A@b.c", "a")]
    return table(spark, rows)


def folder(df, tmp_path, name="documents"):
    df.write.parquet(str(tmp_path / f"{name}.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    return con


@pytest.mark.parametrize("empty", [False, True])
def test_exact(spark, odd, empty):
    df = odd.limit(0) if empty else odd
    rows = exact.mark_exact(df).collect()
    assert len(rows) == df.count()
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in rows}
    if not empty:
        assert (5, 6, 4, False) in got and (6, 6, 4, True) in got and (1, 2, 3, False) in got and (4, 4, 1, True) in got
        assert exact.drop_exact(df).columns == df.columns


def brute_near(rows, k, percent):
    sets = {}
    for i, text in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(ws[j : j + k]) for j in range(max(1, len(ws) - k + 1))} if ws else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near(spark, odd):
    rng = random.Random(9)
    base = words(20, 120).split()
    more = []
    for i in range(60):  # a large group, not all of whose members are linked with each other
        own = list(base)
        for _ in range(rng.randrange(4)):
            own[rng.randrange(len(own))] = f"z{rng.randrange(999)}"
        more.append((100 + i, " ".join(own), "a"))
    df = odd.where("doc_id IS NOT NULL").unionByName(table(spark, more))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near.near_duplicates(df, shingle=3, percent=85).collect()}
    assert got == brute_near([(r.doc_id, r.text) for r in df.collect()], 3, 85)
    assert near.near_duplicates(odd.limit(0)).count() == 0
    assert near.near_duplicates(odd).count() == odd.count()


@pytest.mark.parametrize("block", [1, 5, 256])
def test_near_blocks(spark, block, monkeypatch):
    """A bucket of many components, cut into blocks of any size, loses no link."""
    monkeypatch.setattr(near, "BLOCK", block)
    rng = random.Random(12)
    base = words(21, 160).split()
    rows = []
    for i in range(80):
        own = list(base)
        for _ in range(rng.randrange(2, 9)):
            own[rng.randrange(len(own))] = f"z{rng.randrange(3)}"
        rows.append((i, " ".join(own), "a"))
    df = table(spark, rows)
    want = brute_near([(r.doc_id, r.text) for r in df.collect()], 3, 85)
    assert 5 < len({c for _, c in want.values()}) < 75
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near.near_duplicates(df, shingle=3, percent=85).collect()} == want


def test_sketches_estimate(spark):
    import numpy as np
    import pyarrow as pa

    a = words(30, 400).split()
    b = a[:390] + [f"q{i}" for i in range(10)]
    s = near.signatures(pa.array([" ".join(a), " ".join(b), words(31, 400)]), 3, 32, 4)
    apart = lambda i, j: int(np.bitwise_count((s["odd"][i] ^ s["odd"][j]).view(np.uint64)).sum())
    assert apart(0, 1) < near.sketch_limit(0.85) < apart(0, 2)


def test_substring(spark, odd, tmp_path):
    df = odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    con = folder(df, tmp_path)
    same(substring.op5_substring_dedup(spark, str(tmp_path)), con, substring.ORACLE_SQL["op5_substring_dedup"])
    assert substring.drop_repeats(odd.limit(0)).count() == 0
    assert substring.drop_repeats(odd).count() == odd.count()


def test_substring_cut_runs(spark, tmp_path):
    """A repeat that starts or ends inside a run of equal words, which is longer than LONGEST in one copy only."""
    rows = []
    for i in range(12):
        passage = words(i, 30, 10**6)
        for j, n in enumerate((20, 5)):
            lead, tail = words(9000 + 2 * i + j, 40, 10**6), words(5000 + 2 * i + j, 40, 10**6)
            rows.append((2 * i + j, f"{lead} {'- ' * n}{passage} {tail}" if i % 2 else f"{lead} {passage} {'- ' * n}{tail}", "a"))
    con = folder(table(spark, rows), tmp_path)
    same(substring.op5_substring_dedup(spark, str(tmp_path)), con, substring.ORACLE_SQL["op5_substring_dedup"])
    assert substring.drop_repeats(table(spark, rows)).where("n_removed = 35").count() == 24


def test_decontaminate(spark, odd):
    item = words(3, 50)
    bench = spark.createDataFrame([(1, item), (2, words(4, 50)), (3, "one"), (None, "one two"), (4, None), (5, "")], "item_id long, text string")
    for limit in (10**6, 1):  # in one block, and in many
        got = {r.doc_id: r for r in decontaminate.contamination(odd, bench, block_windows=limit).where("doc_id IS NOT NULL").collect()}
        assert (got[30].n_items, got[30].n_hit, got[30].contaminated) == (2, 100, True)
        assert (got[5].n_items, got[5].n_hit, got[1].n_words) == (1, 1, 0)
    assert decontaminate.contamination(odd, bench.limit(0)).where("n_items > 0").count() == 0


def test_mixing(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, words(i, rng.randrange(0, 60)), None if i % 9 == 0 else "hot" if i % 3 else f"s{i % 8}") for i in range(900)]
    con = folder(table(spark, rows), tmp_path)
    same(mixing.op1_mixing(spark, str(tmp_path)), con, mixing.ORACLE_SQL["op1_mixing"])
    total = con.sql("SELECT sum(len(regexp_extract_all(text, '[^ ]+'))) FROM documents").fetchall()[0][0]
    taken = mixing.op1_mixing(spark, str(tmp_path)).groupBy("source").agg(F.sum("n_tokens").alias("t"), F.first("weight").alias("w")).collect()
    assert all(abs(r.t - r.w * total) <= 61 for r in taken)
    assert mixing.mix(table(spark, rows).limit(0)).count() == 0


def test_pii_base_matches_patterns():
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip, card, phone = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    only = lambda s: re.sub("[^0-9]", "", s)
    rng = random.Random(2)
    for _ in range(4000):
        t = "".join(rng.choice("0123456789.+-() @a1b.") for _ in range(rng.randint(0, 60)))
        want = [(m.start(), 0, m.end()) for m in email.finditer(t)]
        want += [(m.start(), 1, m.end()) for m in ip.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
        want += [(m.start(), 2, m.end()) for m in card.finditer(t) if 14 <= len(only(m.group())) <= 19 and pii.luhn(only(m.group()))]
        want += [(m.start(), 3, m.end()) for m in phone.finditer(t) if 10 <= len(only(m.group())) <= 15]
        assert pii.base_spans(t) == sorted(want)


def test_pii(spark, odd):
    got = {r.doc_id: r for r in pii.find_personal_data(odd).where("doc_id IS NOT NULL").collect()}
    assert got[43].base == "ip:4:11,email:12:17" and got[1].spans == ""
    model = pii.train(["call +1 (171) 555-2028 or write jo.do@example.com or 10.0.0.1 now"] * 40)
    base, every = pii.find("write jo.do (at) example.com", model)
    assert base == [] and [pii.KINDS[k] for _, k, _ in every] == ["email"]
    assert pii.base_spans("9" * 200_000 + "a" * 200_000) == []


def test_pii_long_zone():
    """A list of numbers is one zone of hundreds of tokens; none is lost or broken, and none is cut for training."""
    model = pii.SemiMarkov({"3|digits,sep=11, ()-": 5.0, "3|first=d": 1.0, "3|last=d": 1.0, "3|": -3.0})
    numbers = [f"1 (171) 555-{2000 + i}" for i in range(60)]
    text = "5 " + " ".join(numbers)
    base, every = pii.find(text, model)
    assert len(pii.tokens(text, *pii.zones(text)[0])) > 4 * pii.ZONE_TOKENS and base == []
    assert [text[s:e] for s, _, e in every] == numbers
    marked = " ".join(f"+{n}" for n in numbers)
    cases = list(pii._pieces(pii.tokens(marked, 0, len(marked)), spans := [(17 * i, 3, 17 * i + 17 - 1) for i in range(60)]))
    assert len(cases) > 4 and all(any(c[0] <= s and e <= c[-1] for c in cases) for s, _, e in spans)


def test_pii_trains_on_all_texts():
    """An early text with a long list of addresses doesn't hide the later ones."""
    addresses = "\n".join(f"u{i}@b.c" for i in range(300))
    card = "4111 1111 1111 1111"
    model = pii.train([addresses, *[f"card {card} now"] * 5])
    assert [k for _, k, _ in model.decode(card, pii.tokens(card, 0, len(card)))] == [2]


def test_warc(spark, tmp_path):
    rows = [(1, "http://a/", "<p>ü"), (2, None, "<p>ü"), (3, "http://a/\r\nX: y", None), (4, "u", ""), (5, "u", "z" * 300_000), (None, "u", "alone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"))
    got = {r.page_id: r for r in warc.read_archives(spark, str(tmp_path / "w"), payloads=True).collect()}
    assert (got[2].record_type, got[2].refers_to, got[2].payload_bytes) == ("revisit", 1, 5)
    assert (got[4].record_type, got[4].refers_to, got[3].url) == ("revisit", 3, "http://a/%0D%0AX:%20y")
    assert bytes(got[5].payload) == b"z" * 300_000 and None in got
    files = [p for p in (tmp_path / "w").iterdir() if p.name.startswith("part-")]
    assert sum(gzip.decompress(p.read_bytes()).count(b"WARC/1.1") for p in files) == 6
    with pytest.raises(ValueError, match="inside a gzip member"):
        list(warc.records(warc.record(1, "u", b"x")[:-9]))


def _auc(rows):
    rows = sorted(rows)
    n1 = sum(y for _, y in rows)
    ranks = sum(i + 1 for i, (_, y) in enumerate(rows) if y)
    return (ranks - n1 * (n1 + 1) / 2) / (n1 * (len(rows) - n1))


@pytest.mark.parametrize(("run", "label", "least"), [(toxicity.op9_toxicity, "toxic", 0.85), (quality.op3_quality, "quality", 0.95)])
def test_held_out(spark, run, label, least):
    sf = "/root/testdata/sf0.1"
    rows = run(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("score", label).collect()
    assert _auc([tuple(r) for r in rows]) >= least


def test_quality_buckets():
    """Few of the trigrams of a long text share a bucket."""
    import pyarrow as pa

    text = words(40, 2000, 10**6)
    trigrams = {text[i : i + 3] for i in range(len(text) - 2)}
    used = int((quality.counts(pa.array([text]))[0] > 0).sum())
    assert used > 0.9 * len(trigrams)


def test_classifiers_without_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    model = toxicity.train(odd, none, remainder("doc_id", 5) != 0)
    assert {r.score < 0.01 for r in toxicity.score(odd, model).collect()} == {True}
    space = quality.train(odd, none, remainder("doc_id", 4) != 2, label="quality")
    assert {r.score for r in quality.score(odd, space).collect()} == {0.5}
    assert toxicity.drop_toxic(odd, none).count() == odd.count()


def test_secrets(spark):
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    df = table(spark, [(1, f'my token = "{key}" here', "a"), (2, "a schachchpfheitschverheitenation word", "a"), (3, f"commit {key}", "a"), (4, None, "a"), (5, "", "a"), (6, "=" * 50_000, "a"), (7, f'{key} and token = "{key}"', "a")])
    got = {(r.doc_id, r.number): r.is_secret for r in secrets.scan(df).collect()}
    assert got[1, 0] and not got[2, 0] and not got[3, 0] and not got[6, 0] and got[7, 1]
    assert secrets.scan(df.limit(0)).count() == 0


def test_secrets_short(spark):
    """Short values, and values with other signs, next to a secret word."""
    texts = ["password = 'Tr0ub4dor&3' # mine", "token: 9f86d081884c7d65 now", 'the api_key "Zk3.q9Xw.81LmPv" of', "password = None", "the key to this is patience", "monkey = 'Tr0ub4dor&3'", 'token = "undefined"']
    got = {r.doc_id: (r.candidate, r.is_secret) for r in secrets.scan(table(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect()}
    assert got == {0: ("Tr0ub4dor&3", True), 1: ("9f86d081884c7d65", True), 2: ("Zk3.q9Xw.81LmPv", True), 3: ("None", False), 6: ("undefined", False)}
    both = spark.createDataFrame([("", "a" * 400 + "bcdef", "")], "before string, candidate string, after string")
    assert secrets.with_features(both).first().f_distinct * 40 >= 6

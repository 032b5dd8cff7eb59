"""Hand-computed cases."""

import math

import pytest
from pyspark.sql import functions as F

from weftline.functions import scores as S
from weftline.functions import text as X
from weftline.functions import urls as U
from weftline.operators import network as N
from weftline.operators import pairs as P
from weftline.operators import stats as ST
from weftline.operators import weights as WT
from weftline.operators.articles import dedup_cascade
from weftline.operators.components import components
from weftline.sources import tables


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("url", "want"), [("https://www.a.com/b/", "a.com/b"), ("http://a.com/b/c?x=1", "a.comb"), ("", ""), (None, ""), ("a.com/x+y", r"a.com/x\+y")])
def test_unify_url(spark, url, want):
    assert one(spark, U.unify(F.lit(url).cast("string"))) == want


def test_tokens(spark):
    assert one(spark, X.tokens(F.lit("a  b, c"))) == ["a", "", "b", "c"]
    assert one(spark, X.tokens(F.lit("end.\nStart"))) == ["endStart"]


def test_truncate(spark):
    words = F.lit(" ".join("abcdef"))
    assert one(spark, X.truncate(words, 4, 1)) == "a b c f"
    assert one(spark, X.truncate(words, 4, 0)) == "a b c d"
    assert one(spark, X.truncate(words, 4, 0, compat=True)) == "a b c d a b c d e f"


def test_jaccards(spark):
    arr = lambda *x: F.array(*(F.lit(v) for v in x))
    assert one(spark, P.jaccard(arr(1, 2, 3), arr(2, 3, 4, 5))) == 0.4
    assert one(spark, P.jaccard(F.array().cast("array<int>"), F.array().cast("array<int>"))) == 0
    docs = spark.createDataFrame([(1, "a a b"), (2, "a a a")], "doc_id long, text string")
    occ = {r.doc_id: r.occ for r in P.numbered_tokens(docs).collect()}
    assert len(set(occ[1]) & set(occ[2])) / len(set(occ[1]) | set(occ[2])) == 0.5
    vec = lambda *x: F.array(*(F.struct(F.lit(n).alias("ne"), F.lit(c).cast("long").alias("cnt")) for n, c in x))
    assert one(spark, P.weighted_overlap(vec((1, 2), (2, 1)), vec((1, 1), (3, 4)))) == 0.375


def test_ties_are_kept(spark):
    rows = [(1, f"e{i}", 5.0 if i < 9 else 4.0) for i in range(12)]
    assert WT.top_ties(spark.createDataFrame(rows, "doc_id long, ne string, tfidf double"), 10).count() == 12


def test_dedup_cascade(spark):
    rows = [(2, "u", "t1", 50), (1, "u", "t2", 200), (5, "v", "same", 200), (4, "w", "same", 200)]
    df = spark.createDataFrame(rows, "day int, url string, title string, n int")
    kept = dedup_cascade(df, "url", "title", [F.desc("day")], F.col("n") >= 100).collect()
    assert [(r.day, r.url) for r in kept] == [(5, "v")]


def test_date_window(spark):
    rows = [(1, "e", 3), (2, "e", 8), (3, "e", 9)]
    found = {tuple(r) for r in P.shared_entity_pairs(spark.createDataFrame(rows, "doc_id long, ne string, day int")).collect()}
    assert found == {(1, 2), (2, 3)}


def test_bins_and_classes(spark):
    assert [one(spark, S.time_bin(F.lit(d), F.lit(d))) for d in (6, 18)] == [0, 2]
    assert one(spark, S.index_class(F.lit(7.21))) == pytest.approx(7.6)
    assert [one(spark, S.first_at_least(F.lit(d))) for d in (500.0, 500.1, 20001.0)] == [0, 1, 8]
    assert (one(spark, S.denormalised(F.lit(0.5))), one(spark, S.denormalised(F.lit(0.5), "unsigned"))) == (2.5, 1.75)
    assert S.geodesic_km(0, 0, 0, 1) == pytest.approx(111.3195, abs=1e-3)


def test_population(spark):
    row = ST.pair_population(spark.createDataFrame([(3,), (4,)], "n long")).first()
    assert (row.intra, row.inter) == (18, 12)


def test_similarities_of_distributions(spark):
    d = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.5), ("b", 3, 0.5), ("b", 4, 0.5)], "country string, cluster int, p double")
    assert d.where("country = 'a'").agg(ST.entropy_similarity(F.col("p"), F.lit(4))).first()[0] == pytest.approx(0.5)
    assert ST.js_similarity(d).first().sim == pytest.approx(1 - math.sqrt(math.log(2)))


def test_interval_quantile(spark):
    assert ST.t_quantiles(spark, 10).where("df = 10").first().t == pytest.approx(2.228139, abs=1e-5)


@pytest.mark.parametrize(("n", "want"), [(11, 2.2281388520), (201, 1.9718962236), (202, 1.9718365068), (1001, 1.9623390808), (10_000, 1.9602012636)])
def test_interval_width(spark, n, want):
    """At n - 1 degrees of freedom, for any n; the quantiles are known values."""
    rows = spark.createDataFrame([("a", n, 0.0, 1.0), ("b", 1, 0.0, None)], "g string, n long, mean double, sem double")
    got = {r.g: r.ci95 for r in ST.with_interval(rows).collect()}
    assert got == {"a": pytest.approx(want, abs=1e-7), "b": None}
    assert ST._quantile(n - 1, 0.975) == pytest.approx(want, abs=1e-7)


def test_components(spark):
    rows = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(rows, "a long, b long"), "a", "b").collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_bilateral(spark):
    rows = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 2.0)], "x string, y string, v double")
    assert {(r.a, r.b, r.v) for r in N.bilateral(rows, "x", "y", "v").collect()} == {("a", "b", 3.0), ("b", "a", 3.0)}


def test_article_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, "en", "2020-03-01 10:00"), (2, "fr", None)], "stories_id long, language string, collect_date string")
    tables.write_daily(rows, str(tmp_path / "daily"))
    back = tables.read_articles(spark, str(tmp_path / "daily/*/*"))
    assert {(r.stories_id, r.language) for r in back.collect()} == {(1, "en"), (2, "fr")}
    assert (tmp_path / "daily/lang=fr/date=NAN").is_dir()


def test_streams(spark, tmp_path):
    from weftline.streaming.events import counts, new_urls

    rows = spark.sql("SELECT * FROM VALUES ('u', TIMESTAMP'2024-01-01 00:00:00'), ('u', TIMESTAMP'2024-01-01 01:00:00'), ('v', TIMESTAMP'2024-01-20 00:00:00') AS t(url, ts)")
    rows.write.parquet(str(tmp_path / "in"))
    for name, make in (("urls", lambda s: new_urls(s)), ("windows", lambda s: counts(s, ["url"], width="1 day"))):
        stream = make(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
        q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert spark.sql("SELECT url FROM urls").count() == 2
    assert [tuple(r) for r in spark.sql("SELECT url, n FROM windows").collect()] == [("u", 2)]

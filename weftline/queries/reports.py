"""Enrichment with dimensions, flags, further series and classes, files, small graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import scores as S
from weftline.functions import urls as U
from weftline.operators import graphs as G
from weftline.operators import meeting as ME
from weftline.operators import models as M
from weftline.operators import network as N
from weftline.operators import outlets as O
from weftline.operators import stats as ST
from weftline.plans.scratch import Scratch
from weftline.queries import analysis as A
from weftline.queries.linking import BAG, bag, docs, r6, scored
from weftline.queries.scalars import PLACE, places
from weftline.registry import query
from weftline.sources import tables as T
from weftline.sources.tables import pending, table

# --- statistics

#: The share of Student's t with v degrees of freedom outside [-t, t], by Simpson's rule over the angle atan(t / sqrt(v)).
_BETWEEN = "list_sum(list_transform(range(0, 1001), lambda i: (CASE WHEN i = 0 OR i = 1000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * power(cos({angle} * i / 1000), v - 1))) * {angle} / 3000"
_HALF = "(sqrt(pi()) / 2 * exp(lgamma(v / 2) - lgamma((v + 1) / 2)))"


def _p_sql(inner: str, keys: str, name: str) -> str:
    angle = f"atan(abs({name}) / sqrt(1 - {name} * {name}))"  # of t / sqrt(v) for t of a correlation
    return f"SELECT {keys}, round({name}, 6) AS {name}, n, round(greatest(0, 1 - {_BETWEEN.format(angle=angle)} / {_HALF}), 6) AS p FROM (SELECT *, (n - 2)::DOUBLE AS v FROM ({inner}))"


@query("q_pearson_p", _p_sql("SELECT l_returnflag, l_linestatus, l_linenumber, corr(l_quantity, l_tax) AS r, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 20", "l_returnflag, l_linestatus, l_linenumber", "r"))
def pearson_p(spark, sf):
    keys = ["l_returnflag", "l_linestatus", "l_linenumber"]
    rows = table(spark, sf, "lineitem").groupBy(*keys).agg(F.corr("l_quantity", "l_tax").alias("r"), F.count(F.lit(1)).alias("n")).where("n > 20")
    return ST.with_p_value(rows).select(*keys, r6(F.col("r"), "r"), "n", r6(F.col("p"), "p"))


_RANKS = "SELECT l_returnflag, l_linenumber, rank() OVER (PARTITION BY l_returnflag, l_linenumber ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_linenumber, l_quantity) - 1) / 2 AS a, rank() OVER (PARTITION BY l_returnflag, l_linenumber ORDER BY l_tax) + (count(*) OVER (PARTITION BY l_returnflag, l_linenumber, l_tax) - 1) / 2 AS b FROM lineitem"


@query("q_spearman_p", _p_sql(f"SELECT l_returnflag, l_linenumber, corr(a, b) AS r, count(*) AS n FROM ({_RANKS}) GROUP BY ALL HAVING count(*) > 20", "l_returnflag, l_linenumber", "r"))
def spearman_p(spark, sf):
    keys = ["l_returnflag", "l_linenumber"]
    rows = table(spark, sf, "lineitem").select(*keys, "l_quantity", "l_tax")
    ranked = ST.average_ranks(ST.average_ranks(rows, "l_quantity", keys), "l_tax", keys)
    found = ranked.groupBy(*keys).agg(F.corr("l_quantity_rank", "l_tax_rank").alias("r"), F.count(F.lit(1)).alias("n")).where("n > 20")
    return ST.with_p_value(found).select(*keys, r6(F.col("r"), "r"), "n", r6(F.col("p"), "p"))


def _interval_sql(keys: str) -> str:
    """The t interval from its definition: the angle whose central share is 0.95, by bisection."""
    return f"""WITH RECURSIVE {A.PAIRS}, s AS (SELECT {keys}, count(*) AS n, avg(sim) AS mean, stddev_samp(sim) / sqrt(count(*)) AS sem FROM x GROUP BY {keys}),
    d AS (SELECT DISTINCT (n - 1)::DOUBLE AS v FROM s WHERE n > 1),
    b AS (SELECT v, 0.0::DOUBLE AS lo, pi() / 2 AS hi, 0 AS step FROM d UNION ALL
          SELECT v, CASE WHEN low THEN mid ELSE lo END, CASE WHEN low THEN hi ELSE mid END, step + 1
          FROM (SELECT *, {_BETWEEN.format(angle="mid")} < 0.95 * {_HALF} AS low FROM (SELECT *, (lo + hi) / 2 AS mid FROM b WHERE step < 40)))
    SELECT {keys}, n, round(mean, 6) AS mean, round(sem * sqrt(v) * tan(lo), 6) AS ci95 FROM s LEFT JOIN b ON v = n - 1 AND step = 40"""


def _interval(spark, sf, keys):
    return ST.with_interval(ST.group_stats(A.pairs(spark, sf), keys)).select(*keys, "n", r6(F.col("mean"), "mean"), r6(F.col("ci95"), "ci95"))


@query("q_ci95", _interval_sql("c1"))
def ci95(spark, sf):
    """Means of countries with the half width of their 95 % t interval."""
    return _interval(spark, sf, ["c1"])


@query("q_interval", _interval_sql("c1, c2"))
def interval(spark, sf):
    return _interval(spark, sf, ["c1", "c2"])


_AGREE = "WITH t AS (SELECT count(*)::DOUBLE AS n, avg((quality = toxic)::INT) AS po, avg(quality) AS a, avg(toxic) AS b FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL), u AS (SELECT *, (a + b) / 2 AS m FROM t)"


@query("q_agreement_measures", f"{_AGREE} SELECT round(po, 6) AS agreement, round((po - a * b - (1 - a) * (1 - b)) / (1 - a * b - (1 - a) * (1 - b)), 6) AS cohen, round((po - m * m - (1 - m) * (1 - m)) / (1 - m * m - (1 - m) * (1 - m)), 6) AS scott, round((po - 2 * m * (1 - m)) / (1 - 2 * m * (1 - m)), 6) AS gwet, round(2 * po - 1, 6) AS bennett, round(1 - (1 - po) * (2 * n - 1) / (2 * n) / (2 * m * (1 - m)), 6) AS krippendorff FROM u")
def agreement_measures(spark, sf):
    """Chance-corrected agreement of two raters over two classes."""
    labels = table(spark, sf, "labels").dropna(subset=["quality", "toxic"])
    t = labels.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg((F.col("quality") == F.col("toxic")).cast("int")).alias("po"), F.avg("quality").alias("a"), F.avg("toxic").alias("b"))
    return t.select(*(r6(c, name) for name, c in ST.agreement(F.col("n"), F.col("po"), F.col("a"), F.col("b")).items()))


@query("q_feature_values", "SELECT 'l_linenumber' AS feature, count(DISTINCT l_linenumber) > 1 AS varies FROM lineitem UNION ALL SELECT 'l_quantity', count(DISTINCT l_quantity) > 1 FROM lineitem UNION ALL SELECT 'o_orderstatus of F', count(DISTINCT o_orderstatus) > 1 FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'l_tax', count(DISTINCT l_tax) > 1 FROM lineitem")
def feature_values(spark, sf):
    """Whether each feature has more than one value."""
    items, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders").where("o_orderstatus = 'F'").withColumnRenamed("o_orderstatus", "o_orderstatus of F")
    names = ["l_linenumber", "l_quantity", "l_tax"]
    found = {*ST.varying(items, names), *ST.varying(orders, ["o_orderstatus of F"])}
    return spark.createDataFrame([(n, n in found) for n in (*names, "o_orderstatus of F")], "feature string, varies boolean")


@query("q_source_precedence", "WITH a AS (SELECT DISTINCT o_custkey AS link FROM orders), b AS (SELECT c_custkey AS link FROM customer WHERE c_custkey NOT IN (SELECT link FROM a)), c AS (SELECT p_partkey AS link FROM part WHERE p_partkey NOT IN (SELECT link FROM a UNION ALL SELECT link FROM b)) SELECT link, 'orders' AS origin FROM a UNION ALL SELECT link, 'customers' FROM b UNION ALL SELECT link, 'parts' FROM c")
def source_precedence(spark, sf):
    """Whole sources in order of precedence: each adds the links that none before it has."""
    links = [("orders", "orders", "o_custkey"), ("customer", "customers", "c_custkey"), ("part", "parts", "p_partkey")]
    out = None
    for name, origin, key in links:
        more = table(spark, sf, name).select(F.col(key).alias("link")).distinct().withColumn("origin", F.lit(origin))
        out = more if out is None else out.unionByName(pending(more, out.select("link"), "link"))
    return out


@query("q_flip", f"WITH {A.PAIRS} SELECT k, line, round(5 - sim, 6) AS flipped FROM x")
def flip(spark, sf):
    return A.pairs(spark, sf).select("k", "line", r6(S.flipped(F.col("sim")), "flipped"))


# --- enrichment

_LAST_ORDER = "bias AS (SELECT o_custkey AS media, arg_max(o_orderpriority, o_orderkey) AS bias, arg_max(CASE WHEN o_orderstatus <> 'P' THEN (o_orderkey % 25)::INT ELSE -1 END, o_orderkey) AS country FROM orders GROUP BY o_custkey)"
_DIMENSIONS = f"""{A.PAIRS}, {_LAST_ORDER}, one AS (SELECT c_custkey AS media, CASE WHEN c_acctbal >= 0 THEN c_nationkey END AS pub, (c_nationkey + 5) % 25 AS about FROM customer),
    two AS (SELECT s_suppkey AS media, CASE WHEN s_acctbal >= 0 THEN s_nationkey END AS pub, (s_nationkey + 5) % 25 AS about FROM supplier),
    geo AS (SELECT n_nationkey AS c, n_name AS name, {PLACE['lat']}::DOUBLE AS lat, {PLACE['lon']}::DOUBLE AS lon FROM nation), dem AS (SELECT n_name AS name, avg(s_acctbal) / 1000 AS idx FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY n_name),
    main AS (SELECT k, line, bias.bias AS bias1, coalesce(one.pub, nullif(bias.country, -1), one.about) AS main1, coalesce(two.pub, two.about) AS main2 FROM x LEFT JOIN one ON one.media = media1 LEFT JOIN two ON two.media = media2 LEFT JOIN bias ON bias.media = media1)"""


def enriched(spark, sf):
    """Pairs with their outlets' bias and main country, and that country's name, place and index.

    An outlet's main country is where it is published, else where the list of
    biases puts it, else what it writes about.  Lists with several rows of an
    outlet count with their last.
    """
    order = table(spark, sf, "orders").select(F.col("o_custkey").alias("media1"), F.col("o_orderpriority").alias("bias1"), F.when(F.col("o_orderstatus") != "P", (F.col("o_orderkey") % 25).cast("int")).alias("named"), "o_orderkey")
    bias = O.last_wins(order, ["media1"], "o_orderkey").drop("o_orderkey")
    outlet = lambda name, key, nation, balance, i: table(spark, sf, name).select(F.col(key).alias(f"media{i}"), F.when(F.col(balance) >= 0, F.col(nation)).alias(f"pub{i}"), ((F.col(nation) + 5) % 25).alias(f"about{i}"))
    rows = A.pairs(spark, sf).select("k", "line", "media1", "media2")
    rows = rows.join(outlet("customer", "c_custkey", "c_nationkey", "c_acctbal", 1), "media1", "left").join(outlet("supplier", "s_suppkey", "s_nationkey", "s_acctbal", 2), "media2", "left").join(bias, "media1", "left")
    rows = rows.select("k", "line", "bias1", F.coalesce("pub1", "named", "about1").alias("main1"), F.coalesce("pub2", "about2").alias("main2"))
    nation = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("name"))
    democracy = table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("name").agg((F.avg("s_acctbal") / 1000).alias("idx"))
    country = nation.join(places(spark, sf), "n_nationkey").join(democracy, "name", "left")
    for i in (1, 2):
        rows = rows.join(country.select(F.col("n_nationkey").alias(f"main{i}"), *(F.col(c).alias(f"{c}{i}") for c in ("name", "lat", "lon", "idx"))), f"main{i}", "left")
    return rows


@query("q_enrich_full", f"WITH {_DIMENSIONS} SELECT k, line, bias1, main1, main2, a.name AS name1, b.name AS name2, a.lat AS lat1, b.lon AS lon2, round(p.idx, 6) AS idx1, round(q.idx, 6) AS idx2 FROM main LEFT JOIN geo a ON a.c = main1 LEFT JOIN geo b ON b.c = main2 LEFT JOIN dem p ON p.name = a.name LEFT JOIN dem q ON q.name = b.name")
def enrich_full(spark, sf):
    return enriched(spark, sf).select("k", "line", "bias1", "main1", "main2", "name1", "name2", "lat1", "lon2", r6(F.col("idx1"), "idx1"), r6(F.col("idx2"), "idx2"))


#: Inverse Vincenty on WGS-84, all pairs of places at once, sixty steps of the longitude's difference.
_GEODESIC = f"""WITH RECURSIVE p AS (SELECT n_nationkey AS k, atan((1 - 1 / 298.257223563::DOUBLE) * tan(radians({PLACE['lat']}::DOUBLE))) AS u, radians({PLACE['lon']}::DOUBLE) AS l FROM nation),
    z AS (SELECT a.k AS c1, b.k AS c2, a.u AS u1, b.u AS u2, b.l - a.l AS dl FROM p a JOIN p b ON a.k < b.k),
    v AS (SELECT c1, c2, u1, u2, dl, dl AS lam, 0 AS step FROM z UNION ALL
          SELECT c1, c2, u1, u2, dl, dl + (1 - kk) * f * sa * (sigma + kk * s * (m + kk * c * (2 * m * m - 1))), step + 1 FROM (
          SELECT *, f / 16 * c2a * (4 + f * (4 - 3 * c2a)) AS kk FROM (
          SELECT *, 1 - sa * sa AS c2a, c - 2 * sin(u1) * sin(u2) / (1 - sa * sa) AS m, atan2(s, c) AS sigma FROM (
          SELECT *, cos(u1) * cos(u2) * sin(lam) / s AS sa FROM (
          SELECT *, 1 / 298.257223563::DOUBLE AS f, sqrt(power(cos(u2) * sin(lam), 2) + power(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam), 2)) AS s, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS c FROM v WHERE step < 60))))),
    e AS (SELECT *, c - 2 * sin(u1) * sin(u2) / (1 - sa * sa) AS m, atan2(s, c) AS sigma, (1 - sa * sa) * (power(6378.137, 2) - power(6378.137 * (1 - 1 / 298.257223563), 2)) / power(6378.137 * (1 - 1 / 298.257223563), 2) AS w FROM (
          SELECT *, cos(u1) * cos(u2) * sin(lam) / s AS sa FROM (
          SELECT *, sqrt(power(cos(u2) * sin(lam), 2) + power(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam), 2)) AS s, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS c FROM v WHERE step = 60)))
    SELECT c1, c2, round(6378.137 * (1 - 1 / 298.257223563) * (1 + w / 16384 * (4096 + w * (w * (320 - 175 * w) - 768))) * (sigma - w / 1024 * (256 + w * (w * (74 - 47 * w) - 128)) * s * (m + w / 1024 * (256 + w * (w * (74 - 47 * w) - 128)) / 4 * (c * (2 * m * m - 1) - w / 1024 * (256 + w * (w * (74 - 47 * w) - 128)) / 6 * m * (4 * s * s - 3) * (4 * m * m - 3)))), 3) AS km FROM e"""


@query("q_geodesic", _GEODESIC)
def geodesic(spark, sf):
    """Distances on the ellipsoid between all countries: some hundreds of places."""
    p = places(spark, sf)
    one, two = (p.select(F.col("n_nationkey").alias(f"c{i}"), F.col("lat").alias(f"lat{i}"), F.col("lon").alias(f"lon{i}")) for i in (1, 2))
    return one.join(F.broadcast(two), F.col("c1") < F.col("c2")).select("c1", "c2", F.round(S.geodesic(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")), 3).alias("km"))


_HOST = "string_split(replace(replace(url, 'https://', ''), 'http://', ''), '.')[1]"
_FLAGS = f"""WITH u AS (SELECT page_id, replace(replace(replace(url, 'https://', ''), 'http://', ''), 'www.', '') AS u FROM pages),
    a AS (SELECT {_HOST} AS name, min(page_id) AS first FROM pages WHERE contains(url, '?') AND {_HOST} <> '' GROUP BY 1), b AS (SELECT {_HOST} AS name, min(page_id) AS first FROM pages WHERE contains(url, 'www.') AND {_HOST} <> '' GROUP BY 1),
    ma AS (SELECT page_id, arg_min(name, first) AS name FROM u JOIN a ON u <> '' AND (contains(u, name) OR contains(name, u)) GROUP BY 1), mb AS (SELECT page_id, arg_min(name, first) AS name FROM u JOIN b ON u <> '' AND (contains(u, name) OR contains(name, u)) GROUP BY 1)"""


def _outlet_lists(spark, sf):
    bare = F.replace(F.replace(F.col("url"), F.lit("https://"), F.lit("")), F.lit("http://"), F.lit(""))
    pages = table(spark, sf, "pages")
    urls = pages.select("page_id", F.replace(bare, F.lit("www."), F.lit("")).alias("u"))
    lists = [pages.where(F.col("url").contains(part)).groupBy(F.split(bare, r"\.")[0].alias("name")).agg(F.min("page_id").alias("first")).where("name <> ''") for part in ("?", "www.")]
    return urls, lists


@query("q_outlet_flags", f"{_FLAGS} SELECT page_id, (CASE WHEN ma.name IS NULL THEN '' ELSE 'ABYZ-' END) || (CASE WHEN mb.name IS NULL THEN '' ELSE 'MBFC-' END) AS flag, ma.name AS outlet1, mb.name AS outlet2 FROM u LEFT JOIN ma USING (page_id) LEFT JOIN mb USING (page_id) WHERE ma.name IS NOT NULL OR mb.name IS NOT NULL")
def outlet_flags(spark, sf):
    """Pages matched by either list of outlets, with the marks of the lists that match."""
    urls, (one, two) = _outlet_lists(spark, sf)
    return O.flagged(urls, "page_id", "u", [("ABYZ-", one), ("MBFC-", two)], "name", ["first"]).select("page_id", "flag", "outlet1", "outlet2")


_BIAS = "b AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'right' ELSE 'center' END AS bias, CASE WHEN length(source) % 2 = 0 THEN 'ABYZ-' ELSE 'MBFC-' END AS flag FROM documents)"


@query("q_bias_candidates", f"WITH {BAG}, p AS (SELECT DISTINCT x.doc_id AS doc1, y.doc_id AS doc2, x.lang FROM bag x JOIN bag y ON x.ne = y.ne AND x.lang = y.lang AND x.doc_id < y.doc_id AND abs(x.day - y.day) <= 5), {_BIAS} SELECT doc1, doc2 FROM p JOIN b x ON x.doc_id = doc1 JOIN b y ON y.doc_id = doc2 WHERE CASE WHEN lang = 'en' THEN (x.bias = 'left' AND y.bias = 'right') OR (x.bias = 'right' AND y.bias = 'left') ELSE contains(x.flag, 'ABYZ') END")
def bias_candidates(spark, sf):
    """Pairs of a language that share an entity in the window: English ones of opposite bias, others from flagged outlets."""
    scratch = Scratch(spark, "bias")
    side = F.when(F.col("doc_id") % 3 == 0, 0).when(F.col("doc_id") % 3 == 1, 1)
    about = docs(spark, sf).select("doc_id", F.when(F.length("source") % 2 == 0, "ABYZ-").otherwise("MBFC-").alias("flag"))
    own = ME.vectors(scratch.keep(bag(spark, sf), "bag"), docs(spark, sf), scratch).join(about, "doc_id")
    english = F.col("lang") == "en"
    own = own.withColumn("side", F.when(english, side)).where(~english | F.col("side").isNotNull())
    rows = ME.sharing(own, ME.Meeting(beside=("lang", "flag"), differ="side"), scratch)
    return rows.where((F.col("lang1") == "en") | F.col("flag1").contains("ABYZ")).select("doc1", "doc2")


_CONCEPTS = """WITH names AS (SELECT p_partkey AS term_id, unnest(CASE WHEN p_size > 25 THEN [{'wiki': 'en', 'page': p_brand}, {'wiki': 'de', 'page': p_type}] ELSE [{'wiki': 'en', 'page': p_brand}] END) AS l, p_size > 25 AS several FROM part),
    traffic AS (SELECT title, wiki, arg_max(views, pos) AS views FROM (SELECT replace(p_brand, ' ', '_') AS title, 'en' AS wiki, p_size AS views, p_partkey AS pos FROM part UNION ALL SELECT replace(p_type, ' ', '_'), 'fr', p_size, p_partkey FROM part WHERE p_size % 2 = 0 UNION ALL SELECT replace(p_type, ' ', '_'), 'de', p_size, p_partkey FROM part WHERE p_size > 40) GROUP BY ALL),
    met AS (SELECT term_id, l.wiki AS wiki, l.page AS term, several, views FROM names LEFT JOIN traffic ON title = replace(l.page, ' ', '_') AND traffic.wiki = l.wiki),
    counted AS (SELECT term_id FROM met GROUP BY term_id HAVING count(views) > 0)"""


@query("q_concepts", f"{_CONCEPTS} SELECT term_id, wiki, term, views FROM met WHERE several AND term_id IN (SELECT term_id FROM counted)")
def concepts(spark, sf):
    """Concepts with pages in several languages, at least one with a count: a row for each page; of repeated counts the last."""
    part = table(spark, sf, "part")
    pages = F.when(F.col("p_size") > 25, F.create_map(F.lit("en"), F.col("p_brand"), F.lit("de"), F.col("p_type"))).otherwise(F.create_map(F.lit("en"), F.col("p_brand")))
    names = part.select(F.col("p_partkey").alias("term_id"), pages.alias("languages")).where(F.size("languages") > 1)
    names = names.select("term_id", F.explode("languages").alias("wiki", "term")).withColumn("title", F.replace("term", F.lit(" "), F.lit("_")))
    count = lambda page, wiki: part.select(F.replace(page, F.lit(" "), F.lit("_")).alias("title"), F.lit(wiki).alias("wiki"), F.col("p_size").alias("views"), F.col("p_partkey").alias("at"))
    traffic = count("p_brand", "en").union(count("p_type", "fr").where("views % 2 = 0")).union(count("p_type", "de").where("views > 40"))
    met = names.join(O.last_wins(traffic, ["title", "wiki"], "at").drop("at"), ["title", "wiki"], "left")
    counted = met.groupBy("term_id").agg(F.count("views").alias("n")).where("n > 0")
    return met.join(counted, "term_id", "left_semi").select("term_id", "wiki", "term", "views")


# --- series and classes


def _press_sql(keys: str) -> str:
    return f"WITH {A.PAIRS}, {A.INDEX}, {A.REGION} SELECT kind, class{keys}, count(*) AS n, round(avg(sim), 6) AS mean, round(stddev_samp(sim) / sqrt(count(*)), 6) AS sem FROM (SELECT CASE WHEN c1 = c2 THEN 'intra' ELSE 'inter' END AS kind, (ceil((p.idx + q.idx) / 2 * 10 / 5) * 5)::BIGINT AS class, least(a.g, b.g)::VARCHAR || '-' || greatest(a.g, b.g)::VARCHAR AS system, sim FROM x JOIN i p ON p.c = c1 JOIN i q ON q.c = c2 JOIN r a ON a.c = c1 JOIN r b ON b.c = c2 WHERE c1 = c2 OR abs(p.idx - q.idx) * 10 < 10) GROUP BY ALL"


def _press(spark, sf):
    rows = A.grouped_pairs(spark, sf).join(A.index(spark, sf, 1), "c1").join(A.index(spark, sf, 2), "c2").where("c1 = c2 OR abs(idx1 - idx2) * 10 < 10")
    kind = F.when(F.col("c1") == F.col("c2"), "intra").otherwise("inter")
    return rows.select(kind.alias("kind"), S.index_class((F.col("idx1") + F.col("idx2")) / 2 * 10, "press").cast("long").alias("class"), F.concat_ws("-", F.least("g1", "g2").cast("string"), F.greatest("g1", "g2").cast("string")).alias("system"), "sim")


@query("q_press_class_stats", _press_sql(""))
def press_class_stats(spark, sf):
    return A._stats(_press(spark, sf), ["kind", "class"])


@query("q_press_class_system", _press_sql(", system"))
def press_class_system(spark, sf):
    return A._stats(_press(spark, sf), ["kind", "class", "system"])


@query("q_group_kind_time", f"WITH {A.PAIRS}, {A.REGION} SELECT a.g AS g1, CASE WHEN c1 = c2 THEN 'intra' ELSE 'inter' END AS kind, {A.BIN}, {A._STAT} FROM x JOIN r a ON a.c = c1 JOIN r b ON b.c = c2 WHERE a.g = b.g GROUP BY ALL")
def group_kind_time(spark, sf):
    """A group's series apart for pairs inside a country and between countries."""
    return A._stats(A._binned(spark, sf).where("g1 = g2").withColumn("kind", F.when(F.col("c1") == F.col("c2"), "intra").otherwise("inter")), ["g1", "kind", "bin"])


_DUAL = "dual AS (SELECT c, greatest(gs[1], gs[2])::VARCHAR || '+' || least(gs[1], gs[2])::VARCHAR AS d FROM m WHERE len(gs) = 2)"


@query("q_dual_group_time", f"WITH {A.PAIRS}, {A.MEMBER}, {_DUAL} SELECT a.d AS groups, {A.BIN}, {A._STAT} FROM x JOIN dual a ON a.c = c1 JOIN dual b ON b.c = c2 WHERE a.d = b.d GROUP BY ALL")
def dual_group_time(spark, sf):
    """Series of pairs of countries that are in the same two groups at once."""
    rows = A._binned(spark, sf)
    for i in (1, 2):
        g = F.col(f"gs{i}")
        dual = A.members(spark, sf, i).where(F.size(g) == 2).select(f"c{i}", F.concat_ws("+", F.greatest(g[0], g[1]).cast("string"), F.least(g[0], g[1]).cast("string")).alias(f"d{i}"))
        rows = rows.join(dual, f"c{i}")
    return A._stats(rows.where("d1 = d2").withColumnRenamed("d1", "groups"), ["groups", "bin"])


@query("q_single_group_time", f"WITH {A.PAIRS}, {A.MEMBER} SELECT c1, gs[1] AS g, {A.BIN}, {A._STAT} FROM x JOIN m ON m.c = c1 WHERE c1 = c2 AND len(gs) = 1 GROUP BY ALL")
def single_group_time(spark, sf):
    """Series inside each country that is in one group only."""
    rows = A._binned(spark, sf).where("c1 = c2").join(A.members(spark, sf, 1), "c1").where("size(gs1) = 1").withColumn("g", F.col("gs1")[0])
    return A._stats(rows, ["c1", "g", "bin"])


@query("q_kind_time", f"WITH {A.PAIRS} SELECT CASE WHEN c1 = c2 THEN 'intra' ELSE 'inter' END AS kind, {A.BIN}, {A._STAT} FROM x GROUP BY ALL")
def kind_time(spark, sf):
    """The series over all pairs between countries, and over all inside one."""
    return A._stats(A._binned(spark, sf).withColumn("kind", F.when(F.col("c1") == F.col("c2"), "intra").otherwise("inter")), ["kind", "bin"])


@query("q_filter_index_days", rf"WITH {BAG} SELECT doc_id, count(*) AS n FROM bag WHERE day <> 0 GROUP BY doc_id HAVING count(*) > 10")
def filter_index_days(spark, sf):
    """Documents with more than ten entities, without those of the first day."""
    return bag(spark, sf).where("day <> 0").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 10")


# --- more covariates and features

_COV = "SELECT n_nationkey AS c, n_regionkey AS region, s.*, u.*, o.* FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS suppliers, avg(s_acctbal) AS supply_mean, min(s_acctbal) AS supply_least, max(s_acctbal) AS supply_most, stddev_samp(s_acctbal) AS supply_spread FROM supplier GROUP BY 1) s ON s_nationkey = n_nationkey LEFT JOIN (SELECT c_nationkey, count(*) AS customers, avg(c_acctbal) AS wealth, avg((c_acctbal < 0)::INT) AS in_debt, count(DISTINCT c_mktsegment) AS segments, avg((c_mktsegment = 'BUILDING')::INT) AS building FROM customer GROUP BY 1) u ON c_nationkey = n_nationkey LEFT JOIN (SELECT c_nationkey AS k, count(*) AS orders, avg(o_totalprice) AS price, avg((o_orderstatus = 'F')::INT) AS filled, avg((left(o_orderpriority, 1) = '1')::INT) AS urgent FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1) o ON k = n_nationkey"
_NUMBERS = ["supply_mean", "supply_least", "supply_most", "supply_spread", "wealth", "in_debt", "building", "price", "filled", "urgent"]
_COUNTS = ["region", "suppliers", "customers", "segments", "orders"]


def country_covariates(spark, sf):
    """Fifteen covariates of each country, by a chain of left joins."""
    share = lambda condition: F.avg(condition.cast("int"))
    s = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("c")).agg(
        F.count(F.lit(1)).alias("suppliers"), F.avg("s_acctbal").alias("supply_mean"), F.min("s_acctbal").alias("supply_least"), F.max("s_acctbal").alias("supply_most"), F.stddev_samp("s_acctbal").alias("supply_spread")
    )
    customers = table(spark, sf, "customer")
    u = customers.groupBy(F.col("c_nationkey").alias("c")).agg(
        F.count(F.lit(1)).alias("customers"), F.avg("c_acctbal").alias("wealth"), share(F.col("c_acctbal") < 0).alias("in_debt"), F.count_distinct("c_mktsegment").alias("segments"), share(F.col("c_mktsegment") == "BUILDING").alias("building")
    )
    o = table(spark, sf, "orders").join(customers, F.col("c_custkey") == F.col("o_custkey")).groupBy(F.col("c_nationkey").alias("c")).agg(
        F.count(F.lit(1)).alias("orders"), F.avg("o_totalprice").alias("price"), share(F.col("o_orderstatus") == "F").alias("filled"), share(F.col("o_orderpriority").startswith("1")).alias("urgent")
    )
    out = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c"), F.col("n_regionkey").alias("region"))
    for more in (s, u, o):
        out = out.join(more, "c", "left")
    return out


@query("q_covariate_chain", f"SELECT c, {', '.join(_COUNTS)}, {', '.join(f'round({x}, 6) AS {x}' for x in _NUMBERS)} FROM ({_COV})")
def covariate_chain(spark, sf):
    return country_covariates(spark, sf).select("c", *_COUNTS, *(r6(F.col(x), x) for x in _NUMBERS))


#: Each country's languages, of ten, and its type of state, of three, made from its key.
_SPOKEN = "list_distinct([c % 10, (c * 3 + 1) % 10])"
_LANGUAGES = 10
_MATRIX = f"""WITH {A.PAIRS}, {A.COUNTRY_PAIRS}, {A.MEMBER}, cov AS ({_COV}), l AS (SELECT *, {_SPOKEN} AS spoken, c % 3 AS state FROM cov), w AS (SELECT median(wealth) AS mid FROM cov),
    y AS (SELECT cp.c1, cp.c2, a.region = b.region AS region, list_intersect(a.spoken, b.spoken) AS both_, a.state AS s1, b.state AS s2, a.wealth >= mid AS r1, b.wealth >= mid AS r2, list_intersect(p.gs, q.gs) AS gs, a.wealth AS w1, b.wealth AS w2, a.price AS p1, b.price AS p2 FROM cp JOIN l a ON a.c = cp.c1 JOIN l b ON b.c = cp.c2 JOIN m p ON p.c = cp.c1 JOIN m q ON q.c = cp.c2, w WHERE cp.c1 < cp.c2)"""


@query("q_pair_matrix", f"""{_MATRIX} SELECT c1, c2, region::INT AS same_region, (len(both_) > 0)::INT AS same_language, (s1 = s2)::INT AS same_state, (s1 = 0 AND s2 = 0)::INT AS both_unitary, (r1 AND r2)::INT AS both_rich, (NOT r1 AND NOT r2)::INT AS both_poor, (r1 <> r2)::INT AS rich_and_poor,
    round(abs(w1 - w2), 6) AS wealth_gap, round(p1 * p2, 2) AS price_product, {', '.join(f'list_contains(both_, {i})::INT AS language{i}' for i in range(_LANGUAGES))}, {', '.join(f'list_contains(gs, {i})::INT AS group{i}' for i in range(5))} FROM y""")
def pair_matrix(spark, sf):
    """Indicators of each pair of countries: region, languages one by one, groups one by one, type of state, wealth."""
    cov = country_covariates(spark, sf).select("c", "region", "wealth", "price", F.array_distinct(F.array(F.col("c") % 10, (F.col("c") * 3 + 1) % 10)).alias("spoken"), (F.col("c") % 3).alias("state"))
    middle = cov.agg(F.median("wealth").alias("mid"))
    rows = A.country_pairs(spark, sf).where("c1 < c2").select("c1", "c2")
    for i in (1, 2):
        rows = rows.join(cov.select(*(F.col(c).alias(f"{c}{i}") for c in cov.columns)), f"c{i}").join(A.members(spark, sf, i), f"c{i}")
    rows = rows.crossJoin(F.broadcast(middle))  # one row
    rich1, rich2 = (F.col(f"wealth{i}") >= F.col("mid") for i in (1, 2))
    spoken, groups = F.array_intersect("spoken1", "spoken2"), F.array_intersect("gs1", "gs2")
    flags = {
        "same_region": F.col("region1") == F.col("region2"), "same_language": F.size(spoken) > 0, "same_state": F.col("state1") == F.col("state2"), "both_unitary": (F.col("state1") == 0) & (F.col("state2") == 0),
        "both_rich": rich1 & rich2, "both_poor": ~rich1 & ~rich2, "rich_and_poor": rich1 != rich2,
        **{f"language{i}": F.array_contains(spoken, F.lit(i).cast(cov.schema["spoken"].dataType.elementType)) for i in range(_LANGUAGES)}, **{f"group{i}": F.array_contains(groups, i) for i in range(5)},
    }
    return rows.select("c1", "c2", *(c.cast("int").alias(n) for n, c in flags.items()), r6(F.abs(F.col("wealth1") - F.col("wealth2")), "wealth_gap"), F.round(F.col("price1") * F.col("price2"), 2).alias("price_product"))


# --- files: written below the shared folder and read back


def _articles(spark, sf):
    day = F.concat(F.lit("2020-01-"), F.lpad((F.col("doc_id") % 31 + 1).cast("string"), 2, "0"), F.lit(" 08:00"))
    return docs(spark, sf).select(F.col("doc_id").alias("stories_id"), F.col("lang").alias("language"), F.col("text").alias("story_text"), F.col("source").alias("media_name"), F.when(F.col("doc_id") % 31 < 30, day).alias("collect_date"), F.when(F.col("lang") == "en", day).alias("publish_date"))


@query("q_daily_files", "SELECT doc_id AS stories_id, lang AS language, CASE WHEN doc_id % 31 < 30 THEN '2020-01-' || lpad((doc_id % 31 + 1)::VARCHAR, 2, '0') ELSE 'NAN' END AS date, length(text)::BIGINT AS n FROM documents")
def daily_files(spark, sf):
    """Gzipped JSON lines by language and day; the day is read from the file's name."""
    path = Scratch(spark, "daily").path("articles")
    T.write_daily(_articles(spark, sf), path)
    back = T.read_articles(spark, f"{path}/*/*")
    return back.select("stories_id", "language", F.regexp_extract("file", "/date=([^/]+)/", 1).alias("date"), F.length("story_text").cast("long").alias("n"))


@query("q_published_files", "SELECT CASE WHEN lang = 'en' THEN '2020-01-' || lpad((doc_id % 31 + 1)::VARCHAR, 2, '0') ELSE 'NAN' END AS date, lang, count(*) AS n FROM documents GROUP BY ALL")
def published_files(spark, sf):
    """The same by day of publication; those without one under NAN."""
    path = Scratch(spark, "daily").path("articles")
    T.write_daily(_articles(spark, sf), path, F.col("publish_date"))
    back = T.read_articles(spark, f"{path}/*/*")
    return back.groupBy(F.regexp_extract("file", "/date=([^/]+)/", 1).alias("date"), F.regexp_extract("file", "/lang=([^/]+)/", 1).alias("lang")).agg(F.count(F.lit(1)).alias("n"))


@query("q_index_files", f"WITH {BAG} SELECT doc_id, lang, count(*) AS n_entities, sum(cnt)::BIGINT AS n FROM bag GROUP BY ALL")
def index_files(spark, sf):
    """The article index as tab-separated text with entity bags as JSON, and read back."""
    path = Scratch(spark, "index").path("index")
    T.write_index(bag(spark, sf), path)
    vec = F.col("vec")
    return T.read_index(spark, path).select("doc_id", "lang", F.size(vec).cast("long").alias("n_entities"), F.aggregate(vec, F.lit(0).cast("long"), lambda acc, x: acc + x.cnt).alias("n"))


@query("q_collection_files", "SELECT 'supplier' AS kind, s_name AS name, s_nationkey AS nation, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT 'customer', c_name, c_nationkey, c_mktsegment FROM customer")
def collection_files(spark, sf):
    """Collections with different columns as CSV files of one folder, joined by column name."""
    path = Scratch(spark, "collections").path("csv")
    a = table(spark, sf, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    b = table(spark, sf, "customer").select(F.lit("customer").alias("kind"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    for name, df in (("supplier", a), ("customer", b)):
        T.write_collection(df, f"{path}/{name}")
    back = [T.read_collections(spark, f"{path}/{name}") for name in ("supplier", "customer")]
    out = back[0].unionByName(back[1], allowMissingColumns=True)
    return out.select("kind", "name", F.col("nation").cast("int").alias("nation"), "segment")


@query("q_postings_files", f"WITH {BAG} SELECT ne, doc_id, day, lang FROM bag")
def postings_files(spark, sf):
    """The inverted index as files by entity, and read back."""
    path = Scratch(spark, "postings").path("postings")
    T.write_postings(bag(spark, sf), path)
    return T.read_postings(spark, path)


@query("q_edge_files", f"WITH {A.EDGES} SELECT doc1, doc2, round(weight, 4) + 0.0 AS weight FROM e2")
def edge_files(spark, sf):
    """The weighted edge list as tab-separated text, and read back."""
    path = Scratch(spark, "edges").path("edges")
    T.write_edges(scored(spark, sf).select("doc1", "doc2", F.round(4 - F.col("sim"), 4).alias("similarity")), path)
    return spark.read.schema("doc1 long, doc2 long, weight double").option("sep", "\t").csv(path)


@query("q_dict_file", f"WITH {A.FRACTION} SELECT c::VARCHAR AS key, n::BIGINT AS n FROM a")
def dict_file(spark, sf):
    """Articles of each country as one JSON dictionary, and read back."""
    path = Scratch(spark, "dict").path("totals")
    T.write_dict(A.article_totals(spark, sf), "c", "n", path)
    return T.read_dict(spark, path, "bigint").toDF("key", "n")


@query("q_array_files", "SELECT conv_id, turn, role, length(text)::BIGINT AS n FROM conversations")
def array_files(spark, sf):
    """A JSON array for each conversation, and read back row by row."""
    path = Scratch(spark, "arrays").path("conversations")
    T.write_arrays(table(spark, sf, "conversations"), ["conv_id"], path)
    return T.read_arrays(spark, path, "conv_id long, turn long, role string, text string").select("conv_id", "turn", "role", F.length("text").cast("long").alias("n"))


@query("q_quoted_urls", "SELECT page_id, replace(replace(url_encode(url), '%20', '+'), '~', '%7E') AS quoted FROM pages WHERE regexp_full_match(url, '[A-Za-z0-9:/.?=&%_ +~-]*')")
def quoted_urls(spark, sf):
    return table(spark, sf, "pages").where(F.col("url").rlike("^[A-Za-z0-9:/.?=&%_ +~-]*$")).select("page_id", U.quote(F.col("url")).alias("quoted"))


# --- models and small graphs


@query("q_top_coefficients")
def top_coefficients(spark, sf):
    """The regression's three largest coefficients."""
    rows = A.pair_features(spark, sf)
    fit = M.ols(rows, ST.varying(rows, A.PAIR_COLUMNS), "mean").where("term <> 'intercept'")
    return fit.orderBy(F.desc(F.abs("coefficient")), "term").limit(3).select("term", "coefficient")


@query("q_betweenness")
def betweenness(spark, sf):
    return G.betweenness(N.backbone(A.weighted_edges(spark, sf), 0.3).select("c1", "c2", "weight"))


@query("q_greedy_modularity")
def greedy_modularity(spark, sf):
    return G.greedy_modularity(N.backbone(A.weighted_edges(spark, sf), 0.3).select("c1", "c2", "weight"))

"""Enrichment, grouped statistics, networks, clusters, features and models."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions import scores as S
from weftline.functions import urls as U
from weftline.operators import models as M
from weftline.operators import network as N
from weftline.operators import stats as ST
from weftline.operators.articles import first_wins
from weftline.operators.components import components
from weftline.operators.outlets import matched
from weftline.operators.pairs import top_per
from weftline.queries.linking import EMB, docs, scored
from weftline.queries.scalars import GEO, geo
from weftline.registry import query
from weftline.sources.tables import table

#: Pairs of countries: an item's customer and supplier nations, with a similarity and two days.
PAIRS = """x AS (SELECT l_orderkey AS k, l_linenumber AS line, c_nationkey AS c1, s_nationkey AS c2, o_custkey AS media1, l_suppkey AS media2, 1 + 30 * l_discount AS sim,
    (l_orderkey % 365)::INT AS day1, (l_partkey % 365)::INT AS day2, l_quantity AS q FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey)"""
REGION = "r AS (SELECT n_nationkey AS c, n_regionkey AS g FROM nation)"
INDEX = "i AS (SELECT s_nationkey AS c, avg(s_acctbal) / 1000 AS idx FROM supplier GROUP BY s_nationkey)"


def pairs(spark, sf):
    item, order, customer, supplier = (table(spark, sf, t) for t in ("lineitem", "orders", "customer", "supplier"))
    rows = item.join(order, item.l_orderkey == order.o_orderkey).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), F.col("c_nationkey").alias("c1"), F.col("s_nationkey").alias("c2"), F.col("o_custkey").alias("media1"), F.col("l_suppkey").alias("media2"),
        (1 + 30 * F.col("l_discount")).alias("sim"), (F.col("l_orderkey") % 365).cast("int").alias("day1"), (F.col("l_partkey") % 365).cast("int").alias("day2"), F.col("l_quantity").alias("q"),
    )


def regions(spark, sf, i):
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias(f"c{i}"), F.col("n_regionkey").alias(f"g{i}"))


def index(spark, sf, i):
    return table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias(f"c{i}")).agg((F.avg("s_acctbal") / 1000).alias(f"idx{i}"))


def grouped_pairs(spark, sf):
    return pairs(spark, sf).join(regions(spark, sf, 1), "c1").join(regions(spark, sf, 2), "c2")


def r6(c, name):
    return F.round(c, 6).alias(name)


@query("q_min_support", f"WITH {PAIRS} SELECT c1, count(*) AS n, round(avg(sim), 6) AS mean FROM x GROUP BY c1 HAVING count(*) >= 1000")
def min_support(spark, sf):
    return ST.group_stats(pairs(spark, sf), ["c1"]).where("n >= 1000").select("c1", "n", r6(F.col("mean"), "mean"))


@query("q_varying_features", "SELECT * FROM (SELECT unnest(['l_linenumber', 'l_quantity', 'l_tax']) AS feature)")
def varying_features(spark, sf):
    names = ST.varying(table(spark, sf, "lineitem").withColumn("constant", F.lit(1)), ["l_linenumber", "l_quantity", "l_tax", "constant"])
    return spark.createDataFrame([(n,) for n in names], "feature string")


MEMBER = "m AS (SELECT n_nationkey AS c, list_distinct([n_regionkey, (n_regionkey + n_nationkey % 2) % 5]) AS gs FROM nation)"


def members(spark, sf, i):
    """Nations in one or two groups."""
    g = F.array_distinct(F.array("n_regionkey", (F.col("n_regionkey") + F.col("n_nationkey") % 2) % 5))
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias(f"c{i}"), g.alias(f"gs{i}"))


@query("q_group_within", f"WITH {PAIRS}, {MEMBER} SELECT g, count(*) AS n, round(avg(sim), 6) AS mean FROM (SELECT sim, unnest(list_intersect(a.gs, b.gs)) AS g FROM x JOIN m a ON a.c = c1 JOIN m b ON b.c = c2) GROUP BY g")
def group_within(spark, sf):
    rows = pairs(spark, sf).join(members(spark, sf, 1), "c1").join(members(spark, sf, 2), "c2")
    return ST.group_stats(rows.select("sim", F.explode(F.array_intersect("gs1", "gs2")).alias("g")), ["g"]).select("g", "n", r6(F.col("mean"), "mean"))


@query("q_group_across", f"WITH {PAIRS}, {MEMBER} SELECT combo, count(*) AS n, round(avg(sim), 6) AS mean FROM (SELECT sim, unnest(list_distinct(list_filter(flatten(list_transform(a.gs, lambda g: list_transform(b.gs, lambda h: CASE WHEN g <> h THEN greatest(g, h)::VARCHAR || '-' || least(g, h)::VARCHAR END))), lambda c: c IS NOT NULL))) AS combo FROM x JOIN m a ON a.c = c1 JOIN m b ON b.c = c2) GROUP BY combo")
def group_across(spark, sf):
    rows = pairs(spark, sf).join(members(spark, sf, 1), "c1").join(members(spark, sf, 2), "c2")
    combos = F.array_distinct(F.filter(F.flatten(F.transform("gs1", lambda g: F.transform("gs2", lambda h: F.when(g != h, F.concat_ws("-", F.greatest(g, h).cast("string"), F.least(g, h).cast("string")))))), lambda c: c.isNotNull()))
    return ST.group_stats(rows.select("sim", F.explode(combos).alias("combo")), ["combo"]).select("combo", "n", r6(F.col("mean"), "mean"))


@query("q_outlet_match", "WITH o AS (SELECT string_split(replace(replace(url, 'https://', ''), 'http://', ''), '.')[1] AS name, min(page_id) AS first FROM pages GROUP BY 1), p AS (SELECT page_id, replace(replace(replace(url, 'https://', ''), 'http://', ''), 'www.', '') AS u FROM pages) SELECT page_id, name AS outlet FROM (SELECT page_id, name, row_number() OVER (PARTITION BY page_id ORDER BY first) AS r FROM p JOIN o ON length(name) > 0 AND (contains(u, name) OR contains(name, u))) WHERE r = 1")
def outlet_match(spark, sf):
    bare = F.replace(F.replace(F.col("url"), F.lit("https://"), F.lit("")), F.lit("http://"), F.lit(""))
    pages = table(spark, sf, "pages")
    outlets = pages.groupBy(F.split(bare, r"\.")[0].alias("name")).agg(F.min("page_id").alias("first")).where("length(name) > 0")
    urls = pages.select("page_id", F.replace(bare, F.lit("www."), F.lit("")).alias("u"))
    return matched(urls, "page_id", "u", outlets, "name", ["first"]).select("page_id", F.col("name").alias("outlet"))


@query("q_enrich_pairs", f"WITH {PAIRS}, {REGION}, {INDEX} SELECT k, line, a.g AS g1, b.g AS g2, round(p.idx, 6) AS idx1, round(q.idx, 6) AS idx2 FROM x LEFT JOIN r a ON a.c = c1 LEFT JOIN r b ON b.c = c2 LEFT JOIN i p ON p.c = c1 LEFT JOIN i q ON q.c = c2")
def enrich_pairs(spark, sf):
    rows = pairs(spark, sf)
    for i in (1, 2):
        rows = rows.join(regions(spark, sf, i), f"c{i}", "left").join(index(spark, sf, i), f"c{i}", "left")
    return rows.select("k", "line", "g1", "g2", r6(F.col("idx1"), "idx1"), r6(F.col("idx2"), "idx2"))


@query("q_semi_country", f"WITH {PAIRS}, s AS (SELECT n_nationkey AS c FROM nation WHERE n_regionkey IN (0, 1)) SELECT k, line FROM x WHERE c1 IN (SELECT c FROM s) AND c2 IN (SELECT c FROM s)")
def semi_country(spark, sf):
    some = table(spark, sf, "nation").where("n_regionkey IN (0, 1)").select("n_nationkey")
    rows = pairs(spark, sf)
    for c in ("c1", "c2"):
        rows = rows.join(some.withColumnRenamed("n_nationkey", c), c, "left_semi")
    return rows.select("k", "line")


COVARIATES = "cov AS (SELECT n_nationkey AS c, n_regionkey AS g, s.idx, s.suppliers, u.wealth, u.customers FROM nation LEFT JOIN (SELECT s_nationkey AS c, avg(s_acctbal) / 1000 AS idx, count(*) AS suppliers FROM supplier GROUP BY 1) s ON s.c = n_nationkey LEFT JOIN (SELECT c_nationkey AS c, avg(c_acctbal) / 1000 AS wealth, count(*) AS customers FROM customer GROUP BY 1) u ON u.c = n_nationkey)"


def covariates(spark, sf):
    s = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("c")).agg((F.avg("s_acctbal") / 1000).alias("idx"), F.count(F.lit(1)).alias("suppliers"))
    u = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("c")).agg((F.avg("c_acctbal") / 1000).alias("wealth"), F.count(F.lit(1)).alias("customers"))
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("c"), F.col("n_regionkey").alias("g")).join(s, "c", "left").join(u, "c", "left")


@query("q_covariates", f"WITH {COVARIATES} SELECT c, g, round(idx, 6) AS idx, suppliers, round(wealth, 6) AS wealth, customers FROM cov")
def q_covariates(spark, sf):
    return covariates(spark, sf).select("c", "g", r6(F.col("idx"), "idx"), "suppliers", r6(F.col("wealth"), "wealth"), "customers")


@query("q_inner_merge", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def inner_merge(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select("n_name", "r_name")


@query("q_wiki_merge", "WITH t AS (SELECT p_partkey, p_name, unnest([p_brand, p_type]) AS page FROM part), v AS (SELECT p_brand AS title, max(p_size) AS views FROM part GROUP BY 1) SELECT p_partkey, page, views FROM t JOIN v ON replace(page, ' ', '_') = replace(title, ' ', '_')")
def wiki_merge(spark, sf):
    """A map from language to page name, exploded and joined with the pages' views."""
    part = table(spark, sf, "part")
    pages = part.select("p_partkey", F.explode(F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type"))).alias("wiki", "page"))
    views = part.groupBy(F.replace("p_brand", F.lit(" "), F.lit("_")).alias("title")).agg(F.max("p_size").alias("views"))
    return pages.join(views, F.replace("page", F.lit(" "), F.lit("_")) == F.col("title")).select("p_partkey", "page", "views")


COUNTRY_PAIRS = "cp AS (SELECT least(c1, c2) AS c1, greatest(c1, c2) AS c2, count(*) AS n, avg(sim) AS mean, sum(q) AS trade FROM x GROUP BY 1, 2)"


def country_pairs(spark, sf):
    return pairs(spark, sf).groupBy(*N.undirected(F.col("c1"), F.col("c2"))).agg(F.count(F.lit(1)).alias("n"), F.avg("sim").alias("mean"), F.sum("q").alias("trade"))


@query("q_country_pairs", f"WITH {PAIRS}, {COUNTRY_PAIRS} SELECT c1, c2, n, round(mean, 6) AS mean FROM cp WHERE c1 < c2")
def q_country_pairs(spark, sf):
    return country_pairs(spark, sf).where("c1 < c2").select("c1", "c2", "n", r6(F.col("mean"), "mean"))


@query("q_bilateral_sum", f"WITH {PAIRS}, y AS (SELECT c1, c2, sum(q) AS v FROM x GROUP BY ALL), b AS (SELECT c1 AS a, c2 AS b, v FROM y UNION ALL SELECT c2, c1, v FROM y) SELECT a, b, round(sum(v), 2) AS total, round(max(v), 2) AS largest FROM b GROUP BY ALL")
def bilateral_sum(spark, sf):
    flows = pairs(spark, sf).groupBy("c1", "c2").agg(F.sum("q").alias("v"))
    total, largest = (N.bilateral(flows, "c1", "c2", "v", how).withColumnRenamed("v", how) for how in ("sum", "max"))
    return total.join(largest, ["a", "b"]).select("a", "b", F.round("sum", 2).alias("total"), F.round("max", 2).alias("largest"))


#: Two clusters a document: its label and another.
CLUSTERS = "cl AS (SELECT DISTINCT vec_id AS doc, unnest([label, ((label + vec_id % 3) % 10)::INT]) AS cluster FROM embeddings)"
EDGES = f"{EMB}, e2 AS (SELECT doc1, doc2, 4 - sim AS weight, sim FROM s)"


def clusters(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("doc"), F.explode(F.array_distinct(F.array("label", ((F.col("label") + F.col("vec_id") % 3) % 10).cast("int")))).alias("cluster"))


def edges(spark, sf):
    return scored(spark, sf).select("doc1", "doc2", (4 - F.col("sim")).alias("weight"), "sim")


@query("q_comembership", f"WITH {EDGES}, {CLUSTERS}, k AS (SELECT doc, list(cluster) AS ks FROM cl GROUP BY doc) SELECT doc1, doc2, len(list_intersect(a.ks, b.ks))::INT AS shared, len(list_distinct(a.ks || b.ks))::INT AS total FROM e2 JOIN k a ON a.doc = doc1 JOIN k b ON b.doc = doc2")
def comembership(spark, sf):
    return N.comembership(edges(spark, sf).select("doc1", "doc2"), clusters(spark, sf)).select("doc1", "doc2", "shared", "total")


INSIDE = "ins AS (SELECT a.cluster, doc1, doc2, weight, sim FROM e2 JOIN cl a ON a.doc = doc1 JOIN cl b ON b.doc = doc2 AND a.cluster = b.cluster)"


@query("q_within_cluster", f"WITH {EDGES}, {CLUSTERS}, {INSIDE} SELECT cluster, doc1, doc2, round(weight, 5) AS weight FROM ins")
def within_cluster(spark, sf):
    return N.within_cluster(edges(spark, sf), clusters(spark, sf)).select("cluster", "doc1", "doc2", F.round("weight", 5).alias("weight"))


@query("q_group_stats", f"WITH {PAIRS} SELECT c1, c2, count(*) AS n, round(avg(sim), 6) AS mean, round(sum(sim), 4) AS total FROM x GROUP BY ALL")
def group_stats(spark, sf):
    return pairs(spark, sf).groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("sim"), "mean"), F.round(F.sum("sim"), 4).alias("total"))


@query("q_sem", f"WITH {PAIRS} SELECT c1, count(*) AS n, round(stddev_samp(sim) / sqrt(count(*)), 6) AS sem FROM x GROUP BY c1")
def sem(spark, sf):
    return ST.group_stats(pairs(spark, sf), ["c1"]).select("c1", "n", r6(F.col("sem"), "sem"))


@query("q_pair_population", "WITH n AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) SELECT sum(n * (n - 1))::BIGINT AS intra, ((sum(n) * sum(n) - sum(n * n)) / 2)::BIGINT AS inter FROM n")
def pair_population(spark, sf):
    return ST.pair_population(table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n")))


FRACTION = "a AS (SELECT c, sum(n) AS n FROM (SELECT c_nationkey AS c, count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT s_nationkey, count(*) FROM supplier GROUP BY 1) GROUP BY c)"


def article_totals(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_nationkey").alias("c")).union(table(spark, sf, "supplier").select("s_nationkey"))
    return a.groupBy("c").agg(F.count(F.lit(1)).alias("n"))


@query("q_filter_fraction", f"WITH {PAIRS}, {FRACTION}, {COUNTRY_PAIRS} SELECT c1, c2, round(ln(cp.n / (p.n * q.n)), 6) AS ln_fraction, round(log10(cp.n / (p.n * q.n)), 6) AS log_fraction FROM cp JOIN a p ON p.c = c1 JOIN a q ON q.c = c2 WHERE c1 < c2")
def filter_fraction(spark, sf):
    rows = country_pairs(spark, sf).where("c1 < c2")
    for i in (1, 2):
        rows = rows.join(article_totals(spark, sf).select(F.col("c").alias(f"c{i}"), F.col("n").alias(f"n{i}")), f"c{i}")
    share = F.col("n") / (F.col("n1") * F.col("n2"))
    return rows.select("c1", "c2", r6(F.log(share), "ln_fraction"), r6(F.log10(share), "log_fraction"))


@query("q_country_edges", f"WITH {PAIRS}, {COUNTRY_PAIRS} SELECT c1, c2, n, round(mean, 6) AS mean FROM cp")
def country_edges(spark, sf):
    return country_pairs(spark, sf).select("c1", "c2", "n", r6(F.col("mean"), "mean"))


@query("q_media_num", f"WITH {PAIRS}, m AS (SELECT c1 AS c, 'c' || media1 AS media FROM x UNION SELECT c2, 's' || media2 FROM x) SELECT c, count(*) AS n, least(count(*), 10) AS capped FROM m GROUP BY c")
def media_num(spark, sf):
    p = pairs(spark, sf)
    media = p.select(F.col("c1").alias("c"), F.concat(F.lit("c"), F.col("media1").cast("string")).alias("media")).union(p.select("c2", F.concat(F.lit("s"), F.col("media2").cast("string"))))
    n = F.count_distinct("media")
    return media.groupBy("c").agg(n.alias("n"), F.least(n, F.lit(10)).cast("long").alias("capped"))


@query("q_article_totals", f"WITH {FRACTION} SELECT c, n::BIGINT AS n FROM a")
def q_article_totals(spark, sf):
    return article_totals(spark, sf)


@query("q_pearson", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def pearson(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(r6(F.corr("l_quantity", "l_extendedprice"), "r"), F.count(F.lit(1)).alias("n"))


@query("q_spearman", "WITH k AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS a, rank() OVER (PARTITION BY l_returnflag ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_returnflag, l_discount) - 1) / 2 AS b FROM lineitem) SELECT l_returnflag, round(corr(a, b), 6) AS rho FROM k GROUP BY l_returnflag")
def spearman(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_returnflag", "l_quantity", "l_discount")
    ranked = ST.average_ranks(ST.average_ranks(rows, "l_quantity", ["l_returnflag"]), "l_discount", ["l_returnflag"])
    return ranked.groupBy("l_returnflag").agg(r6(F.corr("l_quantity_rank", "l_discount_rank"), "rho"))


@query("q_superiority", f"WITH {PAIRS}, {REGION}, y AS (SELECT round_even((day1 + day2) / 2 / 12, 0)::INT AS bin, (a.g <> b.g)::INT AS across, sim FROM x JOIN r a ON a.c = c1 JOIN r b ON b.c = c2), u AS (SELECT bin, across, rank() OVER (PARTITION BY bin ORDER BY sim) + (count(*) OVER (PARTITION BY bin, sim) - 1) / 2 AS k FROM y), v AS (SELECT bin, sum(across) AS n1, sum(1 - across) AS n0, sum(CASE WHEN across = 1 THEN k END) AS s FROM u GROUP BY bin) SELECT bin, n1::BIGINT AS n1, n0::BIGINT AS n0, round((s - n1 * (n1 + 1) / 2) / (n1 * n0), 6) AS p FROM v WHERE n1 > 0 AND n0 > 0")
def superiority(spark, sf):
    rows = grouped_pairs(spark, sf).select(S.time_bin(F.col("day1"), F.col("day2")).alias("bin"), (F.col("g1") != F.col("g2")).cast("int").alias("across"), "sim")
    return ST.superiority(rows, ["bin"], "across", "sim").select("bin", "n1", "n0", r6(F.col("p"), "p"))


@query("q_leave_one_out", f"WITH {PAIRS}, {REGION}, y AS (SELECT a.g, c1, sum(sim) AS s, count(*) AS n FROM x JOIN r a ON a.c = c1 GROUP BY ALL) SELECT g AS g1, c1, round((sum(s) OVER (PARTITION BY g) - s) / nullif(sum(n) OVER (PARTITION BY g) - n, 0), 6) AS mean FROM y")
def leave_one_out(spark, sf):
    return ST.leave_one_out(grouped_pairs(spark, sf), ["g1"], "c1", "sim").select("g1", "c1", r6(F.col("mean"), "mean"))


DIST = f"{CLUSTERS}, cd AS (SELECT (doc % 25)::INT AS country, cluster, count(*) AS n FROM cl GROUP BY ALL), di AS (SELECT country, cluster, n, n / sum(n) OVER (PARTITION BY country) AS p FROM cd)"


def country_clusters(spark, sf):
    return N.distribution(clusters(spark, sf).withColumn("country", (F.col("doc") % 25).cast("int")), "country", "cluster")


@query("q_country_cluster", f"WITH {DIST} SELECT country, cluster, n, round(p, 6) AS p FROM di")
def country_cluster(spark, sf):
    return country_clusters(spark, sf).select("country", "cluster", "n", r6(F.col("p"), "p"))


@query("q_entropy_sim", f"WITH {DIST} SELECT country, round(1 + sum(p * ln(p)) / ln(10), 6) AS sim FROM di GROUP BY country")
def entropy_sim(spark, sf):
    return country_clusters(spark, sf).groupBy("country").agg(r6(ST.entropy_similarity(F.col("p"), F.lit(10)), "sim"))


JS = f"""{DIST}, full_ AS (SELECT k.country, q.cluster, coalesce(p, 0) AS p FROM (SELECT DISTINCT country FROM di) k CROSS JOIN (SELECT DISTINCT cluster FROM di) q LEFT JOIN di ON di.country = k.country AND di.cluster = q.cluster),
    js AS (SELECT a.country AS country1, b.country AS country2, 1 - sqrt(greatest(0, sum(CASE WHEN a.p > 0 THEN a.p * ln(2 * a.p / (a.p + b.p)) ELSE 0 END + CASE WHEN b.p > 0 THEN b.p * ln(2 * b.p / (a.p + b.p)) ELSE 0 END) / 2)) AS sim FROM full_ a JOIN full_ b ON a.cluster = b.cluster AND a.country < b.country GROUP BY ALL)"""


@query("q_js_sim", f"WITH {JS} SELECT country1, country2, round(sim, 5) AS sim FROM js")
def js_sim(spark, sf):
    return ST.js_similarity(country_clusters(spark, sf)).select("country1", "country2", F.round("sim", 5).alias("sim"))


@query("q_top_similar", f"WITH {JS}, k AS (SELECT country1, country2, round(sim, 5) AS sim FROM js) SELECT * FROM (SELECT 'top' AS side, * FROM k ORDER BY sim DESC, country1, country2 LIMIT 10) UNION ALL SELECT * FROM (SELECT 'bottom' AS side, * FROM k ORDER BY sim, country1, country2 LIMIT 10)")
def top_similar(spark, sf):
    k = js_sim(spark, sf)
    top = k.orderBy(F.desc("sim"), "country1", "country2").limit(10).select(F.lit("top").alias("side"), "*")
    return top.union(k.orderBy("sim", "country1", "country2").limit(10).select(F.lit("bottom").alias("side"), "*"))


@query("q_modularity", f"WITH {EDGES}, {CLUSTERS}, {INSIDE}, d AS (SELECT doc, sum(w) AS k FROM (SELECT doc1 AS doc, weight AS w FROM e2 UNION ALL SELECT doc2, weight FROM e2) GROUP BY doc), o AS (SELECT doc, count(*) AS o FROM cl GROUP BY doc), m AS (SELECT 2 * sum(weight) AS m2 FROM e2) SELECT round(sum((weight - a.k * b.k / m2) / (p.o * q.o) * 2 / m2), 6) AS q FROM ins JOIN d a ON a.doc = doc1 JOIN d b ON b.doc = doc2 JOIN o p ON p.doc = doc1 JOIN o q ON q.doc = doc2, m")
def modularity(spark, sf):
    return N.modularity(edges(spark, sf), clusters(spark, sf)).select(r6(F.col("q"), "q"))


@query("q_modularity_textbook", f"WITH {EDGES}, {CLUSTERS}, {INSIDE}, d AS (SELECT doc, sum(w) AS k FROM (SELECT doc1 AS doc, weight AS w FROM e2 UNION ALL SELECT doc2, weight FROM e2) GROUP BY doc), o AS (SELECT doc, count(*) AS o FROM cl GROUP BY doc), m AS (SELECT 2 * sum(weight) AS m2 FROM e2), l AS (SELECT sum(2 * weight / (p.o * q.o)) AS a FROM ins JOIN o p ON p.doc = doc1 JOIN o q ON q.doc = doc2), x AS (SELECT sum(s * s) AS e FROM (SELECT cluster, sum(k / o) AS s FROM cl JOIN d USING (doc) JOIN o USING (doc) GROUP BY cluster)) SELECT round((a - e / m2) / m2, 6) AS q FROM l, x, m")
def modularity_textbook(spark, sf):
    return N.modularity(edges(spark, sf), clusters(spark, sf), textbook=True).select(r6(F.col("q"), "q"))


@query("q_partition_density", f"WITH {EDGES}, {CLUSTERS}, {INSIDE}, z AS (SELECT cluster, count(*) AS n FROM cl GROUP BY 1), l AS (SELECT cluster, count(*) AS m FROM ins GROUP BY 1) SELECT round(2 / sum(m) * sum(CASE WHEN n > 2 THEN m * (m - n + 1) / ((n - 2) * (n - 1)) ELSE 0 END), 6) AS d FROM z JOIN l USING (cluster)")
def partition_density(spark, sf):
    return N.partition_density(edges(spark, sf), clusters(spark, sf)).select(r6(F.col("d"), "d"))


LIMITS = [1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 4.5, 5.0, 5.5]


@query("q_cocluster_curve", f"WITH {EDGES}, {CLUSTERS}, k AS (SELECT doc, list(cluster) AS ks FROM cl GROUP BY doc), y AS (SELECT round(sim, 5) AS sim, (len(list_intersect(a.ks, b.ks)) > 0)::INT AS both_ FROM e2 JOIN k a ON a.doc = doc1 JOIN k b ON b.doc = doc2) SELECT t, count(*) AS n, round(avg(both_), 6) AS ratio FROM y JOIN (SELECT unnest({LIMITS})::DOUBLE AS t) ON sim <= t GROUP BY t")
def cocluster_curve(spark, sf):
    """Cumulative: the pairs at or below each limit."""
    limits = F.array(*(F.lit(t) for t in LIMITS))
    rows = N.comembership(edges(spark, sf).select("doc1", "doc2", F.round("sim", 5).alias("sim")), clusters(spark, sf))
    each = rows.select(F.explode(F.filter(limits, lambda t: F.col("sim") <= t)).alias("t"), (F.col("shared") > 0).cast("int").alias("both"))
    return each.groupBy("t").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("both"), "ratio"))


@query("q_label_ratio", f"WITH {EDGES}, {CLUSTERS}, k AS (SELECT doc, list(cluster) AS ks FROM cl GROUP BY doc) SELECT label, sum(i)::BIGINT AS within_n, sum(1 - i)::BIGINT AS between_n, round(sum(i) / count(*), 6) AS ratio FROM (SELECT least(3, floor(round(sim, 5)))::INT AS label, (len(list_intersect(a.ks, b.ks)) > 0)::INT AS i FROM e2 JOIN k a ON a.doc = doc1 JOIN k b ON b.doc = doc2) GROUP BY label")
def label_ratio(spark, sf):
    rows = N.comembership(edges(spark, sf).select("doc1", "doc2", F.least(F.lit(3), F.floor(F.round("sim", 5))).cast("int").alias("label")), clusters(spark, sf))
    i = (F.col("shared") > 0).cast("long")
    return rows.groupBy("label").agg(F.sum(i).alias("within_n"), F.sum(1 - i).alias("between_n"), r6(F.sum(i) / F.count(F.lit(1)), "ratio"))


@query("q_cluster_hist", "WITH c AS (SELECT source AS cluster, count(*) AS size, max(doc_id % 31) - min(doc_id % 31) AS span, count(DISTINCT lang) AS langs FROM documents GROUP BY source) SELECT CASE WHEN size <= 10 THEN 0 WHEN size <= 100 THEN 1 ELSE 2 END AS size_class, span::INT AS span, langs, count(*) AS n FROM c GROUP BY ALL")
def cluster_hist(spark, sf):
    c = docs(spark, sf).groupBy("source").agg(F.count(F.lit(1)).alias("size"), (F.max("day") - F.min("day")).alias("span"), F.count_distinct("lang").alias("langs"))
    return c.groupBy(S.first_at_least(F.col("size"), (10, 100)).alias("size_class"), "span", "langs").agg(F.count(F.lit(1)).alias("n"))


@query("q_within_between", f"WITH {EDGES}, {CLUSTERS}, k AS (SELECT doc, list(cluster) AS ks FROM cl GROUP BY doc), y AS (SELECT sim, len(list_intersect(a.ks, b.ks)) > 0 AS i FROM e2 JOIN k a ON a.doc = doc1 JOIN k b ON b.doc = doc2) SELECT round(avg(CASE WHEN i THEN sim END), 5) AS within_mean, round(avg(CASE WHEN NOT i THEN sim END), 5) AS between_mean FROM y")
def within_between(spark, sf):
    rows = N.comembership(edges(spark, sf).select("doc1", "doc2", "sim"), clusters(spark, sf))
    return rows.agg(F.round(F.avg(F.when(F.col("shared") > 0, F.col("sim"))), 5).alias("within_mean"), F.round(F.avg(F.when(F.col("shared") == 0, F.col("sim"))), 5).alias("between_mean"))


@query("q_top_outlets", "SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL AND source <> 'None' GROUP BY source ORDER BY n DESC, source LIMIT 10")
def top_outlets(spark, sf):
    return docs(spark, sf).where("source IS NOT NULL AND source <> 'None'").groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source").limit(10)


@query("q_multiset_sum", "SELECT key, sum(n)::BIGINT AS n FROM (SELECT c_nationkey AS key, count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT s_nationkey, -10 * count(*) FROM supplier GROUP BY 1) GROUP BY key HAVING sum(n) > 0")
def multiset_sum(spark, sf):
    a = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    b = table(spark, sf, "supplier").groupBy("s_nationkey").agg((-10 * F.count(F.lit(1))).alias("n"))
    return a.union(b).groupBy("key").agg(F.sum("n").alias("n")).where("n > 0")


@query("q_label_mean", "SELECT event_type, user_id, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def label_mean(spark, sf):
    return table(spark, sf, "events").groupBy("event_type", "user_id").agg(r6(F.avg("value"), "mean"))


@query("q_agreement", "WITH c AS (SELECT avg((quality = toxic)::INT) AS po, avg(quality) AS a, avg(toxic) AS b FROM labels) SELECT round((po - (a * b + (1 - a) * (1 - b))) / (1 - (a * b + (1 - a) * (1 - b))), 6) AS kappa FROM c")
def agreement(spark, sf):
    c = table(spark, sf, "labels").agg(F.avg((F.col("quality") == F.col("toxic")).cast("int")).alias("po"), F.avg("quality").alias("a"), F.avg("toxic").alias("b"))
    pe = F.col("a") * F.col("b") + (1 - F.col("a")) * (1 - F.col("b"))
    return c.select(r6((F.col("po") - pe) / (1 - pe), "kappa"))


@query("q_corpus_stats", "SELECT (date_diff('day', DATE '2020-01-01', CAST(ts AS DATE)))::INT AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def corpus_stats(spark, sf):
    return table(spark, sf, "events").groupBy(S.relative_day(F.to_date("ts")).alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("q_min_bias", "SELECT o_orderkey, min(o_orderpriority) OVER (PARTITION BY o_custkey) AS least FROM orders")
def min_bias(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.min("o_orderpriority").over(W.partitionBy("o_custkey")).alias("least"))


@query("q_drop_dups", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def drop_dups(spark, sf):
    return first_wins(table(spark, sf, "orders"), ["o_custkey"], [F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("q_top_clusters_month", f"WITH {CLUSTERS}, m AS (SELECT cluster, (doc % 210 // 30)::INT AS month, count(*) AS n FROM cl GROUP BY ALL) SELECT month, cluster, n FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY n DESC, cluster) AS r FROM m) WHERE r <= 5")
def top_clusters_month(spark, sf):
    m = clusters(spark, sf).groupBy("cluster", S.month_bin(F.col("doc") % 210).alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return top_per(m, "month", 5, [F.desc("n"), F.col("cluster")]).select("month", "cluster", "n")


@query("q_group_total", "SELECT o_orderkey, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_orderstatus), 9) AS share FROM orders")
def group_total(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    totals = rows.groupBy("o_orderstatus").agg(F.sum("o_totalprice").alias("total"))  # a few rows
    return rows.join(totals, "o_orderstatus").select("o_orderkey", F.round(F.col("o_totalprice") / F.col("total"), 9).alias("share"))


@query("q_top_edges", f"WITH {PAIRS}, {COUNTRY_PAIRS} SELECT c1, c2, n FROM cp WHERE c1 < c2 ORDER BY n DESC, c1, c2 LIMIT 80")
def top_edges(spark, sf):
    return country_pairs(spark, sf).where("c1 < c2").orderBy(F.desc("n"), "c1", "c2").limit(80).select("c1", "c2", "n")


@query("q_sample_cluster", f"WITH {CLUSTERS} SELECT cluster, doc FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY md5(cluster || '|' || doc), doc) AS r FROM cl) WHERE r <= 10")
def sample_cluster(spark, sf):
    order = [F.md5(F.concat_ws("|", F.col("cluster").cast("string"), F.col("doc").cast("string"))), F.col("doc")]
    return top_per(clusters(spark, sf), "cluster", 10, order).select("cluster", "doc")


@query("q_intruder", f"WITH {CLUSTERS}, s AS (SELECT cluster, doc FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY md5(cluster || '|' || doc), doc) AS r FROM cl) WHERE r <= 10), f AS (SELECT (cluster + 1) % 10 AS cluster, min(doc) AS doc FROM s WHERE doc NOT IN (SELECT doc FROM cl c WHERE c.cluster = (s.cluster + 1) % 10) GROUP BY 1) SELECT cluster, doc, 0 AS intruder FROM s UNION ALL SELECT cluster::INT, doc, 1 FROM f")
def intruder(spark, sf):
    """Ten sampled members of each cluster and one of the cluster before it that isn't a member."""
    own = sample_cluster(spark, sf)
    foreign = own.select(((F.col("cluster") + 1) % 10).alias("cluster"), "doc").join(clusters(spark, sf), ["cluster", "doc"], "left_anti").groupBy("cluster").agg(F.min("doc").alias("doc"))
    return own.select("cluster", "doc", F.lit(0).alias("intruder")).union(foreign.select("cluster", "doc", F.lit(1)))


@query("q_split", "SELECT doc_id, CASE WHEN k <= floor(0.8 * n) THEN 'train' WHEN k <= floor(0.9 * n) THEN 'dev' ELSE 'test' END AS part FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k, count(*) OVER (PARTITION BY source) AS n FROM documents)")
def split(spark, sf):
    """Positional split of each source's documents."""
    w = W.partitionBy("source")
    rows = docs(spark, sf).select("doc_id", F.row_number().over(w.orderBy("doc_id")).alias("k"), F.count(F.lit(1)).over(w).alias("n"))
    return rows.select("doc_id", F.when(F.col("k") <= F.floor(0.8 * F.col("n")), "train").when(F.col("k") <= F.floor(0.9 * F.col("n")), "dev").otherwise("test").alias("part"))


@query("q_minmax", "SELECT p_partkey, round((p_size - min(p_size) OVER ()) / (max(p_size) OVER () - min(p_size) OVER ())::DOUBLE, 6) AS size, round((p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()), 6) AS price FROM part")
def minmax(spark, sf):
    scaled = ST.min_max(table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"])
    return scaled.select("p_partkey", r6(F.col("p_size"), "size"), r6(F.col("p_retailprice"), "price"))


@query("q_metrics", "WITH y AS (SELECT quality AS l, (doc_id % 4 <> 0)::INT AS p, (doc_id % 7)::DOUBLE AS s FROM labels), c AS (SELECT sum((l = 1 AND p = 1)::INT)::DOUBLE AS tp, sum((l = 0 AND p = 1)::INT)::DOUBLE AS fp, sum((l = 1 AND p = 0)::INT)::DOUBLE AS fn, sum((l = 0 AND p = 0)::INT)::DOUBLE AS tn FROM y), k AS (SELECT l, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS r FROM y), a AS (SELECT (sum(CASE WHEN l = 1 THEN r END) - sum(l) * (sum(l) + 1) / 2) / (sum(l) * sum(1 - l)) AS auc FROM k) SELECT round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc, round(auc, 6) AS auc FROM c, a")
def metrics(spark, sf):
    y = table(spark, sf, "labels").select("quality", (F.col("doc_id") % 4 != 0).cast("int").alias("p"), (F.col("doc_id") % 7).cast("double").alias("s"))
    m = ST.binary_metrics(y, "quality", "p", "s")
    return m.select(*(r6(F.col(c), c) for c in m.columns))


@query("q_ols_simple", "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY l_returnflag")
def ols_simple(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"), F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 3).alias("intercept"), r6(F.regr_r2("l_extendedprice", "l_quantity"), "r2"))


@query("q_label_expand", "SELECT doc_id, i, (('0x' || left(md5(doc_id || '|' || i), 4))::INT % 10 < 3 + 4 * quality)::INT AS label FROM labels, (SELECT unnest(range(1, 11))::INT AS i)")
def label_expand(spark, sf):
    """Ten copies of each label, rounded at random by a hash."""
    rows = table(spark, sf, "labels").select("doc_id", "quality", F.explode(F.sequence(F.lit(1), F.lit(10))).alias("i"))
    draw = F.conv(F.left(F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("i").cast("string"))), F.lit(4)), 16, 10).cast("int") % 10
    return rows.select("doc_id", "i", (draw < 3 + 4 * F.col("quality")).cast("int").alias("label"))


WEIGHTED = f"{PAIRS}, {COUNTRY_PAIRS}, we AS (SELECT c1, c2, n::DOUBLE AS weight FROM cp WHERE c1 < c2)"


def weighted_edges(spark, sf):
    return country_pairs(spark, sf).where("c1 < c2").select("c1", "c2", F.col("n").cast("double").alias("weight"))


@query("q_edge_norm", f"WITH {WEIGHTED}, l AS (SELECT min(weight) AS lo, max(weight) AS hi FROM we) SELECT c1, c2, round((weight - lo) / (hi - lo), 6) AS weight FROM we, l")
def edge_norm(spark, sf):
    return ST.min_max(weighted_edges(spark, sf), ["weight"]).select("c1", "c2", r6(F.col("weight"), "weight"))


@query("q_backbone", f"WITH {WEIGHTED}, st AS (SELECT c, count(*) AS k, sum(weight) AS s FROM (SELECT c1 AS c, weight FROM we UNION ALL SELECT c2, weight FROM we) GROUP BY c) SELECT c1, c2, round(least(pow(1 - weight / a.s, a.k - 1), pow(1 - weight / b.s, b.k - 1)), 6) AS alpha FROM we JOIN st a ON a.c = c1 JOIN st b ON b.c = c2 WHERE least(pow(1 - weight / a.s, a.k - 1), pow(1 - weight / b.s, b.k - 1)) < 0.3")
def backbone(spark, sf):
    return N.backbone(weighted_edges(spark, sf), 0.3).select("c1", "c2", r6(F.col("alpha"), "alpha"))


_ROUNDS = 4
_RANKS = ", ".join(f"r{i + 1} AS (SELECT b AS c, 0.15::DOUBLE / (SELECT count(*) FROM r0) + 0.85::DOUBLE * sum(r * share) AS r FROM sh JOIN r{i} ON r{i}.c = a GROUP BY b)" for i in range(_ROUNDS))


@query("q_pagerank", f"WITH {WEIGHTED}, bo AS (SELECT c1 AS a, c2 AS b, weight FROM we UNION ALL SELECT c2, c1, weight FROM we), sh AS (SELECT a, b, weight / sum(weight) OVER (PARTITION BY a) AS share FROM bo), r0 AS (SELECT a AS c, 1 / count(*) OVER () AS r FROM (SELECT DISTINCT a FROM bo)), {_RANKS} SELECT c, round(r, 6) AS r FROM r{_ROUNDS}")
def pagerank(spark, sf):
    return N.page_rank(weighted_edges(spark, sf), _ROUNDS).select("c", r6(F.col("r"), "r"))


@query("q_communities")
def communities(spark, sf):
    return N.label_propagation(weighted_edges(spark, sf))


@query("q_components", "WITH RECURSIVE e AS (SELECT vec_id AS a, vec_id + 10 AS b FROM embeddings WHERE vec_id % 7 <> 0 AND vec_id + 10 IN (SELECT vec_id FROM embeddings)), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT DISTINCT a AS node, a AS root FROM u UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.node) SELECT node, min(root) AS component FROM r GROUP BY node")
def q_components(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id")
    links = e.where("vec_id % 7 <> 0").select(F.col("vec_id").alias("a"), (F.col("vec_id") + 10).alias("b")).join(e.withColumnRenamed("vec_id", "b"), "b", "left_semi")
    return components(links, "a", "b")


@query("q_degree", f"WITH {EDGES} SELECT doc, count(*) AS degree, round(sum(w), 4) AS strength FROM (SELECT doc1 AS doc, weight AS w FROM e2 UNION ALL SELECT doc2, weight FROM e2) GROUP BY doc")
def degree(spark, sf):
    e = edges(spark, sf)
    return e.select(F.col("doc1").alias("doc"), "weight").union(e.select("doc2", "weight")).groupBy("doc").agg(F.count(F.lit(1)).alias("degree"), F.round(F.sum("weight"), 4).alias("strength"))


@query("q_edge_export", f"WITH {EDGES} SELECT doc1, doc2, round(weight, 4) AS weight FROM e2 WHERE weight > 1")
def edge_export(spark, sf):
    return edges(spark, sf).where("weight > 1").select("doc1", "doc2", F.round("weight", 4).alias("weight"))


@query("q_parse_clusters", f"WITH {CLUSTERS} SELECT cluster, count(*) AS n, min(doc) AS first FROM cl GROUP BY cluster")
def parse_clusters(spark, sf):
    """Clusters written as text and parsed again."""
    from weftline.plans.scratch import Scratch
    from weftline.sources.tables import read_clusters

    path = Scratch(spark, "clusters").path("text")
    ids = F.concat_ws(" ", F.transform(F.array_sort(F.collect_list("doc")), lambda d: d.cast("string")))
    text = clusters(spark, sf).groupBy("cluster").agg(ids.alias("ids")).select(F.concat(F.lit("#module "), F.col("cluster").cast("string"), F.lit(" size\n"), F.col("ids")).alias("value"))
    text.write.text(path)
    return read_clusters(spark, path).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("first"))


@query("q_map_nodes", f"WITH {PAIRS}, {FRACTION}, y AS (SELECT c1 AS c, count(*) AS n, avg(sim) AS mean FROM x WHERE c1 = c2 GROUP BY 1) SELECT c, y.n, round(mean, 6) AS mean, round(y.n / (a.n * (a.n - 1)), 9) AS fraction, round(power(300, 1 / (mean + 0.1)), 4) AS drawn FROM y JOIN a USING (c)")
def map_nodes(spark, sf):
    own = pairs(spark, sf).where("c1 = c2").groupBy(F.col("c1").alias("c")).agg(F.count(F.lit(1)).alias("n"), F.avg("sim").alias("mean"))
    rows = own.join(article_totals(spark, sf).withColumnRenamed("n", "a"), "c")
    return rows.select("c", "n", r6(F.col("mean"), "mean"), F.round(F.col("n") / (F.col("a") * (F.col("a") - 1)), 9).alias("fraction"), F.round(S.display(F.col("mean"), 300), 4).alias("drawn"))


@query("q_map_edges", f"WITH {PAIRS}, {FRACTION}, {COUNTRY_PAIRS} SELECT c1, c2, cp.n, round(mean, 6) AS mean, round(cp.n / (p.n * q.n), 9) AS fraction, round(power(1000, 1 / (mean + 0.1)), 3) AS drawn FROM cp JOIN a p ON p.c = c1 JOIN a q ON q.c = c2 WHERE c1 < c2")
def map_edges(spark, sf):
    rows = country_pairs(spark, sf).where("c1 < c2")
    for i in (1, 2):
        rows = rows.join(article_totals(spark, sf).select(F.col("c").alias(f"c{i}"), F.col("n").alias(f"n{i}")), f"c{i}")
    return rows.select("c1", "c2", "n", r6(F.col("mean"), "mean"), F.round(F.col("n") / (F.col("n1") * F.col("n2")), 9).alias("fraction"), F.round(S.display(F.col("mean"), 1000), 3).alias("drawn"))


def _class_sql(extra: str = "", keys: str = "") -> str:
    return f"WITH {PAIRS}, {INDEX}, {REGION} SELECT kind, class{keys}, count(*) AS n, round(avg(sim), 6) AS mean, round(stddev_samp(sim) / sqrt(count(*)), 6) AS sem FROM (SELECT CASE WHEN c1 = c2 THEN 'intra' ELSE 'inter' END AS kind, round(ceil((p.idx + q.idx) / 2 * 2.5) / 2.5, 6) AS class, sim{extra} FROM x JOIN i p ON p.c = c1 JOIN i q ON q.c = c2 JOIN r a ON a.c = c1 JOIN r b ON b.c = c2 WHERE c1 = c2 OR abs(p.idx - q.idx) < 0.6) GROUP BY ALL"


def _classes(spark, sf):
    rows = grouped_pairs(spark, sf).join(index(spark, sf, 1), "c1").join(index(spark, sf, 2), "c2").where("c1 = c2 OR abs(idx1 - idx2) < 0.6")
    kind = F.when(F.col("c1") == F.col("c2"), "intra").otherwise("inter")
    return rows.select(kind.alias("kind"), r6(S.index_class((F.col("idx1") + F.col("idx2")) / 2), "class"), "sim", F.concat_ws("-", F.least("g1", "g2").cast("string"), F.greatest("g1", "g2").cast("string")).alias("system"))


@query("q_index_class_stats", _class_sql())
def index_class_stats(spark, sf):
    return ST.group_stats(_classes(spark, sf), ["kind", "class"]).select("kind", "class", "n", r6(F.col("mean"), "mean"), r6(F.col("sem"), "sem"))


@query("q_index_class_system", _class_sql(", least(a.g, b.g)::VARCHAR || '-' || greatest(a.g, b.g)::VARCHAR AS system", ", system"))
def index_class_system(spark, sf):
    return ST.group_stats(_classes(spark, sf), ["kind", "class", "system"]).select("kind", "class", "system", "n", r6(F.col("mean"), "mean"), r6(F.col("sem"), "sem"))


BIN = "round_even((day1 + day2) / 2 / 12, 0)::INT AS bin"


def _binned(spark, sf):
    return grouped_pairs(spark, sf).withColumn("bin", S.time_bin(F.col("day1"), F.col("day2")))


def _stats(rows, keys):
    return ST.group_stats(rows, keys).select(*keys, "n", r6(F.col("mean"), "mean"), r6(F.col("sem"), "sem"))


_STAT = "count(*) AS n, round(avg(sim), 6) AS mean, round(stddev_samp(sim) / sqrt(count(*)), 6) AS sem"


@query("q_group_time", f"WITH {PAIRS}, {REGION} SELECT a.g AS g1, {BIN}, {_STAT} FROM x JOIN r a ON a.c = c1 JOIN r b ON b.c = c2 WHERE a.g = b.g GROUP BY ALL")
def group_time(spark, sf):
    return _stats(_binned(spark, sf).where("g1 = g2"), ["g1", "bin"])


@query("q_combo_time", f"WITH {PAIRS}, {REGION} SELECT greatest(a.g, b.g)::VARCHAR || '-' || least(a.g, b.g)::VARCHAR AS combo, {BIN}, {_STAT} FROM x JOIN r a ON a.c = c1 JOIN r b ON b.c = c2 WHERE a.g <> b.g GROUP BY ALL")
def combo_time(spark, sf):
    combo = F.concat_ws("-", F.greatest("g1", "g2").cast("string"), F.least("g1", "g2").cast("string"))
    return _stats(_binned(spark, sf).where("g1 <> g2").withColumn("combo", combo), ["combo", "bin"])


@query("q_country_time", f"WITH {PAIRS} SELECT c1, {BIN}, {_STAT} FROM x WHERE c1 = c2 GROUP BY ALL")
def country_time(spark, sf):
    return _stats(_binned(spark, sf).where("c1 = c2"), ["c1", "bin"])


@query("q_level_time", f"WITH {PAIRS}, {COUNTRY_PAIRS} SELECT (cp.n % 3)::INT AS level, {BIN}, {_STAT.replace('sim', 'x.sim')} FROM x JOIN cp ON cp.c1 = least(x.c1, x.c2) AND cp.c2 = greatest(x.c1, x.c2) WHERE x.c1 <> x.c2 GROUP BY ALL")
def level_time(spark, sf):
    levels = country_pairs(spark, sf).select(F.col("c1").alias("lo"), F.col("c2").alias("hi"), (F.col("n") % 3).cast("int").alias("level"))
    rows = _binned(spark, sf).where("c1 <> c2").withColumn("lo", F.least("c1", "c2")).withColumn("hi", F.greatest("c1", "c2"))
    return _stats(rows.join(levels, ["lo", "hi"]), ["level", "bin"])


@query("q_distance_stats", f"WITH {PAIRS}, {GEO} SELECT (SELECT count(*) FROM unnest([500, 1000, 2000, 3000, 4000, 5000, 10000, 20000]) AS t(v) WHERE v < km)::INT AS class, count(*) AS n, round(avg(sim), 6) AS mean, round(ln(count(*)), 6) AS log_n FROM x JOIN g ON g.c1 = least(x.c1, x.c2) AND g.c2 = greatest(x.c1, x.c2) GROUP BY class HAVING count(*) >= 1000")
def distance_stats(spark, sf):
    km = geo(spark, sf).select(F.col("c1").alias("lo"), F.col("c2").alias("hi"), "km")
    rows = pairs(spark, sf).where("c1 <> c2").withColumn("lo", F.least("c1", "c2")).withColumn("hi", F.greatest("c1", "c2")).join(km, ["lo", "hi"])
    out = ST.group_stats(rows.withColumn("class", S.first_at_least(F.col("km"))), ["class"]).where("n >= 1000")
    return out.select("class", "n", r6(F.col("mean"), "mean"), r6(F.log("n"), "log_n"))


PAIR_FEATURES = f"{PAIRS}, {COUNTRY_PAIRS}, {COVARIATES}, pf AS (SELECT c1, c2, mean, n, trade, (a.g = b.g)::INT AS same_region, (abs(c1 - c2) = 1)::INT AS border, abs(a.idx - b.idx) AS idx_gap, abs(a.wealth - b.wealth) AS wealth_gap, (a.idx < 4.5 AND b.idx < 4.5)::INT AS both_low, (a.idx >= 4.5 AND b.idx >= 4.5)::INT AS both_high FROM cp JOIN cov a ON a.c = c1 JOIN cov b ON b.c = c2 WHERE c1 < c2)"
PAIR_COLUMNS = ["same_region", "border", "idx_gap", "wealth_gap", "both_low", "both_high"]


def pair_features(spark, sf):
    rows = country_pairs(spark, sf).where("c1 < c2")
    for i in (1, 2):
        cov = covariates(spark, sf)
        rows = rows.join(cov.select(*(F.col(c).alias(f"{c}{i}") for c in ("c", "g", "idx", "wealth"))), f"c{i}")
    flag = lambda c: c.cast("int")
    return rows.select(
        "c1", "c2", "mean", "n", "trade", flag(F.col("g1") == F.col("g2")).alias("same_region"), flag(F.abs(F.col("c1") - F.col("c2")) == 1).alias("border"),
        F.abs(F.col("idx1") - F.col("idx2")).alias("idx_gap"), F.abs(F.col("wealth1") - F.col("wealth2")).alias("wealth_gap"),
        flag((F.col("idx1") < 4.5) & (F.col("idx2") < 4.5)).alias("both_low"), flag((F.col("idx1") >= 4.5) & (F.col("idx2") >= 4.5)).alias("both_high"),
    )


@query("q_pair_features", f"WITH {PAIR_FEATURES} SELECT c1, c2, n, same_region, border, round(idx_gap, 6) AS idx_gap, round(wealth_gap, 6) AS wealth_gap, both_low, both_high, round(mean, 6) AS mean FROM pf")
def q_pair_features(spark, sf):
    return pair_features(spark, sf).select("c1", "c2", "n", "same_region", "border", r6(F.col("idx_gap"), "idx_gap"), r6(F.col("wealth_gap"), "wealth_gap"), "both_low", "both_high", r6(F.col("mean"), "mean"))


@query("q_country_features", f"WITH {PAIRS}, {COVARIATES}, m AS (SELECT c1 AS c, avg(sim) AS mean, avg((media1 % 10 = media2 % 10)::INT) AS same_media FROM x WHERE c1 = c2 GROUP BY 1) SELECT c, g, round(mean, 6) AS mean, round(same_media, 6) AS same_media, round(idx, 6) AS idx, round(wealth, 6) AS wealth FROM m JOIN cov USING (c)")
def country_features(spark, sf):
    own = pairs(spark, sf).where("c1 = c2").groupBy(F.col("c1").alias("c")).agg(F.avg("sim").alias("mean"), F.avg((F.col("media1") % 10 == F.col("media2") % 10).cast("int")).alias("same_media"))
    return own.join(covariates(spark, sf), "c").select("c", "g", *(r6(F.col(c), c) for c in ("mean", "same_media", "idx", "wealth")))


@query("q_regression")
def regression(spark, sf):
    rows = pair_features(spark, sf)
    return M.ols(rows, ST.varying(rows, PAIR_COLUMNS), "mean")


@query("q_selected_features")
def selected_features(spark, sf):
    rows = pair_features(spark, sf)
    chosen, path = M.select_features(rows, ST.varying(rows, PAIR_COLUMNS), "n")
    return spark.createDataFrame([(i, f, float(path[i])) for i, f in enumerate(["", *chosen])], "step int, feature string, aic double")


@query("q_importances")
def importances(spark, sf):
    return M.importances(pair_features(spark, sf), PAIR_COLUMNS, "mean")


def _classified(spark, sf):
    return table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id").select("quality", F.length("text").alias("chars"), F.regexp_count("text", F.lit(r"[|#$%&*!]")).alias("signs"), F.size(F.split("text", " ")).alias("words"))


@query("q_logistic")
def logistic(spark, sf):
    return M.balanced_logistic(_classified(spark, sf), ["chars", "signs", "words"], "quality").groupBy("label", "prediction").count()


@query("q_linear_svc")
def linear_svc(spark, sf):
    return M.linear_svc(_classified(spark, sf), ["chars", "signs", "words"], "quality").groupBy("label", "prediction").count()


@query("q_cluster_mean_sim", f"WITH {EDGES}, {CLUSTERS}, {INSIDE} SELECT cluster, count(*) AS n, round(avg(sim), 5) AS mean FROM ins GROUP BY cluster")
def cluster_mean_sim(spark, sf):
    inside = N.within_cluster(edges(spark, sf), clusters(spark, sf))
    return inside.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(4 - F.col("weight")), 5).alias("mean"))


@query("q_shuffled", "SELECT doc_id FROM documents")
def shuffled(spark, sf):
    return docs(spark, sf).select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(3)))


@query("q_hosts", "SELECT string_split_regex(replace(replace(replace(trim(url), 'https://', ''), 'http://', ''), 'www.', ''), '[/?]')[1] AS host, count(*) AS n FROM pages WHERE NOT contains(url, '?') GROUP BY 1")
def hosts(spark, sf):
    return table(spark, sf, "pages").where(~F.col("url").contains("?")).groupBy(U.host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"))

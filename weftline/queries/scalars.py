"""Projections, filters and scalar functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import scores as S
from weftline.functions import text as X
from weftline.functions import urls as U
from weftline.registry import query
from weftline.sources.tables import table

CLEAN = r"regexp_replace(coalesce(text, ''), '[^\p{L}\p{N}_ ]', '', 'g')"
TOKENS = f"string_split({CLEAN}, ' ')"


def r6(c, name):
    return F.round(c, 6).alias(name)


@query("q_scan_articles", "SELECT doc_id, lang, source, length(text)::BIGINT AS n FROM documents")
def scan_articles(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang", "source", F.length("text").cast("long").alias("n"))


@query("q_partition_counts", "SELECT event_type, CAST(ts AS DATE)::VARCHAR AS day, count(*) AS n FROM events GROUP BY ALL")
def partition_counts(spark, sf):
    return table(spark, sf, "events").groupBy("event_type", F.to_date("ts").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("q_fetch_articles", "SELECT d.doc_id, d.source, d.n_chars FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic = 1")
def fetch_articles(spark, sf):
    wanted = table(spark, sf, "labels").where("toxic = 1").select("doc_id")
    return table(spark, sf, "documents").join(wanted, "doc_id").select("doc_id", "source", "n_chars")


@query("q_pending_files", "SELECT DISTINCT source FROM documents WHERE source NOT IN (SELECT source FROM documents JOIN labels USING (doc_id) WHERE quality = 0 AND source IS NOT NULL)")
def pending_files(spark, sf):
    docs = table(spark, sf, "documents")
    done = docs.join(table(spark, sf, "labels").where("quality = 0"), "doc_id").select("source").distinct()
    return docs.select("source").distinct().join(done, "source", "left_anti")


@query("q_union_collections", "SELECT 'supplier' AS origin, s_name AS name, s_nationkey AS nation, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT 'customer', c_name, c_nationkey, c_mktsegment FROM customer")
def union_collections(spark, sf):
    a = table(spark, sf, "supplier").select(F.lit("supplier").alias("origin"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    b = table(spark, sf, "customer").select(F.lit("customer").alias("origin"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    return a.unionByName(b, allowMissingColumns=True)


@query("q_block_urls", "SELECT page_id, url FROM pages WHERE NOT regexp_matches(url, 'casino|sport|reddit.com|facebook.com|twitter.com|fb.com|wikipedia.org|epochtimes.com|youtube.com|slideshare.net')")
def block_urls(spark, sf):
    return table(spark, sf, "pages").where(~U.blocked(F.col("url"), ("casino", *U.BLOCKED))).select("page_id", "url")


@query("q_min_length", f"SELECT doc_id, len({TOKENS})::INT AS n_tokens FROM documents WHERE len({TOKENS}) >= 100")
def min_length(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(X.tokens(F.col("text"))).alias("n_tokens")).where(F.col("n_tokens") >= X.MIN_TOKENS)


@query("q_lang_scaled_length", f"SELECT doc_id, lang, len({TOKENS})::INT AS n_tokens FROM documents WHERE len({TOKENS}) >= 100 * CASE lang WHEN 'de' THEN 0.87 WHEN 'es' THEN 1.13 WHEN 'fr' THEN 1.1 ELSE 1.0 END")
def lang_scaled_length(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", F.size(X.tokens(F.col("text"))).alias("n_tokens"))
    return d.where(F.col("n_tokens") >= X.MIN_TOKENS * X.translation_ratio(F.col("lang")))


@query("q_date_range", "SELECT o_orderkey, CAST(o_orderdate AS DATE)::VARCHAR AS day FROM orders WHERE o_orderdate >= DATE '1995-03-01' AND o_orderdate < DATE '1995-04-01'")
def date_range(spark, sf):
    inside = (F.col("o_orderdate") >= F.lit("1995-03-01").cast("timestamp")) & (F.col("o_orderdate") < F.lit("1995-04-01").cast("timestamp"))
    return table(spark, sf, "orders").where(inside).select("o_orderkey", F.to_date("o_orderdate").cast("string").alias("day"))


@query("q_dropna", "SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL AND l.toxic IS NOT NULL")
def dropna(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").dropna(subset=["quality", "toxic"]).select("doc_id", "quality", "toxic")


@query("q_unify_url", r"""SELECT page_id, replace(replace(CASE WHEN contains(u, '?') THEN array_to_string(string_split(u, '/')[:-2], '') ELSE u END, '+', '\+'), '*', '\*') AS url
    FROM (SELECT page_id, CASE WHEN ends_with(v, '/') THEN left(v, length(v) - 1) ELSE v END AS u
    FROM (SELECT page_id, replace(replace(replace(trim(coalesce(url, '')), 'https://', ''), 'http://', ''), 'www.', '') AS v FROM pages))""")
def unify_url(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.unify(F.col("url")).alias("url"))


@query("q_tokens", f"SELECT doc_id, len({TOKENS})::INT AS n, md5(array_to_string(list_sort({TOKENS}), '|')) AS bag FROM documents")
def tokens(spark, sf):
    t = X.tokens(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(t).alias("n"), F.md5(F.array_join(F.array_sort(t), "|")).alias("bag"))


@query("q_sentences", r"SELECT doc_id, md5(array_to_string(list_sort(list_distinct(list_transform(list_filter(string_split(text, '.'), lambda s: length(s) > 40), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')))), '|')) AS sentences FROM documents")
def sentences(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(F.array_join(F.array_sort(X.sentences(F.col("text"), F.col("lang"))), "|")).alias("sentences"))


@query("q_truncate", f"""SELECT doc_id, md5(CASE WHEN len(t) > 64 THEN array_to_string(t[1:48], ' ') || ' ' || array_to_string(t[-16:], ' ') ELSE array_to_string(t, ' ') END) AS digest
    FROM (SELECT doc_id, {TOKENS} AS t FROM documents)""")
def truncate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(X.truncate(F.col("text"), 64, 16)).alias("digest"))


@query("q_printable", r"SELECT doc_id, md5(translate(regexp_replace(translate(text, ' ', chr(57344)), '[\p{Z}\p{Cc}\p{Cf}]', '', 'g'), chr(57344), ' ')) AS digest FROM documents")
def printable(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(X.printable(F.col("text"))).alias("digest"))


@query("q_score_norm", "SELECT l_orderkey, l_linenumber, round((4 - s) / 3, 6) AS positive, round((5 - 2 * s) / 3, 6) AS unsigned FROM (SELECT l_orderkey, l_linenumber, 1 + 3 * l_discount AS s FROM lineitem)")
def score_norm(spark, sf):
    s = 1 + 3 * F.col("l_discount")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", r6(S.normalised(s), "positive"), r6(S.normalised(s, "unsigned"), "unsigned"))


@query("q_score_denorm", "SELECT l_orderkey, l_linenumber, round(greatest(1, least(4, 4 - 3 * n)), 6) AS positive, round(greatest(1, least(4, (5 - 3 * n) / 2)), 6) AS unsigned FROM (SELECT l_orderkey, l_linenumber, 20 * l_discount - 0.5 AS n FROM lineitem)")
def score_denorm(spark, sf):
    n = 20 * F.col("l_discount") - 0.5
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", r6(S.clamped(S.denormalised(n)), "positive"), r6(S.clamped(S.denormalised(n, "unsigned")), "unsigned"))


_LIKERT = "['VERY DISSIMILAR', 'SOMEWHAT DISSIMILAR', 'SOMEWHAT SIMILAR', 'VERY SIMILAR', 'Other']"


@query("q_label_ordinal", f"""SELECT doc_id, CASE WHEN k < 5 THEN k END AS ordinal, CASE WHEN k < 5 THEN round((4 - k) / 3.0::DOUBLE, 6) END AS score
    FROM (SELECT doc_id, (1 + (doc_id % 5))::INT AS k FROM labels)""")
def label_ordinal(spark, sf):
    names = F.array(*(F.lit(x) for x in (*S.LABELS, "Other")))
    k = S.label_ordinal(F.element_at(names, (F.col("doc_id") % 5 + 1).cast("int")))
    return table(spark, sf, "labels").select("doc_id", k.alias("ordinal"), r6((4 - k) / 3, "score"))


@query("q_weighted_label", "SELECT doc_id, round(0.9 * quality + 0.1 * toxic, 6)::DOUBLE AS w1, round(0.75 * quality + 0.25 * toxic, 6)::DOUBLE AS w2, round(power(0.9 * quality + 0.1 * toxic, 3), 6) AS cubed FROM labels")
def weighted_label(spark, sf):
    mix = lambda a: a * F.col("quality") + (1 - a) * F.col("toxic")
    return table(spark, sf, "labels").select("doc_id", r6(0.9 * F.col("quality") + 0.1 * F.col("toxic"), "w1"), r6(mix(0.75), "w2"), r6(F.pow(0.9 * F.col("quality") + 0.1 * F.col("toxic"), 3), "cubed"))


@query("q_sim_transform", "SELECT l_orderkey, l_linenumber, round(power(300, 1 / (s + 0.1)), 6) AS node, round(power(1000, 1 / (s + 0.1)), 6) AS edge, round(power(100, 1 / (s + 0.1)), 6) AS dem FROM (SELECT l_orderkey, l_linenumber, 1 + 3 * l_discount AS s FROM lineitem)")
def sim_transform(spark, sf):
    s = 1 + 3 * F.col("l_discount")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", r6(S.display(s, 300), "node"), r6(S.display(s, 1000), "edge"), r6(S.display(s, 100), "dem"))


@query("q_reladate", "SELECT o_orderkey, abs(date_diff('day', DATE '2020-01-01', CAST(o_orderdate AS DATE)))::INT AS day FROM orders")
def reladate(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", S.relative_day(F.to_date("o_orderdate")).alias("day"))


@query("q_week_of_month", "SELECT o_orderkey, (strftime(o_orderdate, '%W')::INT - strftime(date_trunc('month', o_orderdate), '%W')::INT + 1)::INT AS week FROM orders")
def week_of_month(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", S.week_of_month(F.to_date("o_orderdate")).alias("week"))


@query("q_time_bin", "SELECT l_orderkey, l_linenumber, round_even((l_orderkey % 365 + l_partkey % 365) / 2 / 12, 0)::INT AS bin, (l_orderkey % 365 // 30)::INT AS month FROM lineitem")
def time_bin(spark, sf):
    a, b = F.col("l_orderkey") % 365, F.col("l_partkey") % 365
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.time_bin(a, b).alias("bin"), S.month_bin(a).alias("month"))


@query("q_index_class", "SELECT s_suppkey, round(ceil(s_acctbal / 1000 * 2.5) / 2.5, 6) + 0.0 AS democracy, (ceil(s_acctbal / 100 / 5) * 5)::BIGINT AS press FROM supplier")
def index_class(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", r6(S.index_class(F.col("s_acctbal") / 1000), "democracy"), S.index_class(F.col("s_acctbal") / 100, "press").cast("long").alias("press"))


@query("q_distance_class", "SELECT s_suppkey, (SELECT count(*) FROM unnest([500, 1000, 2000, 3000, 4000, 5000, 10000, 20000]) AS t(x) WHERE x < s_acctbal)::INT AS class FROM supplier")
def distance_class(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", S.first_at_least(F.col("s_acctbal")).alias("class"))


#: Families of the languages covered.
FAMILIES = {"en": "Germanic", "de": "Germanic", "fr": "Romance", "es": "Romance", "pt": "Romance", "it": "Romance", "pl": "Slavic", "ru": "Slavic", "zh": "Sinitic", "ko": "Koreanic", "ar": "Semitic", "tr": "Turkic"}


@query("q_lang_family", "SELECT doc_id, CASE WHEN lang IN ('en', 'de') THEN 'Germanic' WHEN lang IN ('fr', 'es') THEN 'Romance' ELSE '' END AS family FROM documents")
def lang_family(spark, sf):
    pairs = F.create_map(*(F.lit(x) for kv in FAMILIES.items() for x in kv))
    return table(spark, sf, "documents").select("doc_id", F.coalesce(pairs[F.col("lang")], F.lit("")).alias("family"))


@query("q_ner_type", "SELECT doc_id, CASE WHEN lang IN ('en', 'es', 'fr', 'de') THEN 'spacy' WHEN lang IN ('ko', 'ar', 'tr') THEN 'polyglot' ELSE 'wrong language' END AS engine FROM documents")
def ner_type(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.entity_engine(F.col("lang")).alias("engine"))


@query("q_max_ne", rf"SELECT doc_id, greatest(len(list_filter({TOKENS}, lambda w: length(w) >= 2 AND regexp_matches(w, '^\p{{Lu}}'))), len(list_filter({TOKENS}, lambda w: regexp_matches(w, '^[0-9]'))), len(list_filter({TOKENS}, lambda w: length(w) >= 12)))::INT AS n FROM documents")
def max_ne(spark, sf):
    words = X.tokens(F.col("text"))
    kinds = [X.entities(F.col("text")), F.filter(words, lambda w: w.rlike("^[0-9]")), F.filter(words, lambda w: F.length(w) >= 12)]
    return table(spark, sf, "documents").select("doc_id", F.greatest(*(F.size(k) for k in kinds)).alias("n"))


@query("q_country_norm", "SELECT n_nationkey, lower(trim(string_split(replace(replace(n_name, 'UNITED STATES', 'USA'), chr(160), ' '), ' (')[1])) AS name FROM nation")
def country_norm(spark, sf):
    name = F.replace(F.replace(F.col("n_name"), F.lit("UNITED STATES"), F.lit("USA")), F.lit(" "), F.lit(" "))
    return table(spark, sf, "nation").select("n_nationkey", F.lower(F.trim(F.split(name, r" \(")[0])).alias("name"))


PLACE = {"lat": "(n_nationkey * 7 % 140 - 70)", "lon": "(n_nationkey * 29 % 340 - 170)"}


def places(spark, sf):
    """A place for each nation, made from its key."""
    return table(spark, sf, "nation").select("n_nationkey", F.expr(f"double{PLACE['lat']}").alias("lat"), F.expr(f"double{PLACE['lon']}").alias("lon"))


GEO = f"""p AS (SELECT n_nationkey AS k, {PLACE['lat']}::DOUBLE AS lat, {PLACE['lon']}::DOUBLE AS lon FROM nation),
    g AS (SELECT a.k AS c1, b.k AS c2, 2 * {S.EARTH_KM} * asin(sqrt(power(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2))) AS km FROM p a JOIN p b ON a.k < b.k)"""


def geo(spark, sf):
    p = places(spark, sf)
    a, b = (p.select(F.col("n_nationkey").alias(f"c{i}"), F.col("lat").alias(f"lat{i}"), F.col("lon").alias(f"lon{i}")) for i in (1, 2))
    # At most a few hundred countries: a triangle over a dimension table.
    return a.join(F.broadcast(b), F.col("c1") < F.col("c2")).select("c1", "c2", S.haversine_km(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")).alias("km"))


@query("q_geo_distance", f"WITH {GEO} SELECT c1, c2, round(km, 3) AS km FROM g")
def geo_distance(spark, sf):
    return geo(spark, sf).select("c1", "c2", F.round("km", 3).alias("km"))


@query("q_date_decay", "SELECT l_orderkey, l_linenumber, round(power(0.9, l_linenumber), 6) AS decay FROM lineitem")
def date_decay(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", r6(S.date_decay(F.col("l_linenumber"), 0.9), "decay"))


@query("q_json_props", "SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events")
def json_props(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k INT").k.alias("k"))


#: Words of three topics; a vocabulary is (lang, topic, term).
TOPICS = [("en", "motion", "ing"), ("en", "being", "was"), ("de", "motion", "geht"), ("de", "being", "ist"), ("fr", "being", "est"), ("es", "being", "es")]


@query("q_topic_tags", f"""SELECT DISTINCT doc_id, topic FROM (SELECT doc_id, lang, list_transform({TOKENS}, lambda w: lower(w)) AS t FROM documents) d
    JOIN (VALUES {', '.join(str(t) for t in TOPICS)}) v(l, topic, term) ON d.lang = v.l AND list_contains(t, term)""")
def topic_tags(spark, sf):
    words = spark.createDataFrame(TOPICS, "lang string, topic string, term string")
    docs = table(spark, sf, "documents").select("doc_id", "lang", F.transform(X.tokens(F.col("text")), F.lower).alias("t"))
    return docs.join(F.broadcast(words), "lang").where(F.array_contains("t", F.col("term"))).select("doc_id", "topic").distinct()


@query("q_conversation_turns", "SELECT conv_id, count(*) AS turns, sum(length(text))::BIGINT AS chars, sum((role = 'user')::INT)::BIGINT AS user_turns FROM conversations GROUP BY conv_id")
def conversation_turns(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.sum(F.length("text")).cast("long").alias("chars"), F.sum((F.col("role") == "user").cast("long")).alias("user_turns"))

"""Readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARTICLE = """stories_id BIGINT, url STRING, media_id BIGINT, media_name STRING, media_url STRING, title STRING, story_text STRING,
language STRING, publish_date STRING, collect_date STRING,
spacy ARRAY<STRUCT<text: STRING, start_char: INT, end_char: INT, label: STRING>>,
polyglot ARRAY<STRUCT<text: ARRAY<STRING>, type: STRING>>,
wiki_concepts ARRAY<STRUCT<term_id: BIGINT, term: STRING, wiki: STRING, views: BIGINT>>"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_articles(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    """Articles as JSON lines, gzipped or not (by file name), or as JSON arrays; with the file's name."""
    reader = spark.read.schema(ARTICLE)
    if array:
        reader = reader.option("multiLine", True)
    return reader.json(path).withColumn("file", F.input_file_name())


def read_collections(spark: SparkSession, path: str) -> DataFrame:
    """The union of all CSV files of a folder by column name."""
    return spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_daily(articles: DataFrame, path: str, date: Column | None = None) -> None:
    """Articles by language and day; those without a date under NAN."""
    day = F.coalesce(F.substring(F.col("collect_date") if date is None else date, 1, 10), F.lit("NAN"))
    articles.withColumn("lang", F.col("language")).withColumn("date", day).repartition("lang", "date").write.mode("append").partitionBy("lang", "date").json(path, compression="gzip")


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """``(cluster, doc)`` from text where a line ``#module n ...`` starts each cluster's lines of ids."""
    parts = spark.read.option("lineSep", "#").text(path).where(F.col("value").rlike(r"^module\s"))
    cluster = F.regexp_extract("value", r"^module\s+(\d+)", 1).cast("int")
    ids = F.filter(F.split(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s+"), lambda x: x != "")
    return parts.select(cluster.alias("cluster"), F.explode(ids).alias("doc")).withColumn("doc", F.col("doc").cast("long"))


def pending(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Inputs that no record names yet."""
    return inputs.join(done, key, "left_anti")


def write_edges(pairs: DataFrame, path: str, a: str = "doc1", b: str = "doc2", weight: str = "similarity") -> None:
    """A weighted edge list as tab-separated text, as graph clustering programs read it."""
    pairs.select(a, b, weight).write.option("sep", "\t").csv(path)


def write_index(bag: DataFrame, path: str) -> None:
    """An article index as tab-separated text: doc_id, lang, day and the entity bag as JSON."""
    vec = F.to_json(F.sort_array(F.collect_list(F.struct("ne", "cnt"))))  # a document's own entities
    bag.groupBy("doc_id", "lang", "day").agg(vec.alias("vec")).write.option("sep", "\t").option("quote", "").option("escape", "").csv(path, compression="gzip")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("doc_id long, lang string, day int, vec string").option("sep", "\t").option("quote", "").option("escape", "").csv(path)
    return rows.withColumn("vec", F.from_json("vec", "array<struct<ne: string, cnt: bigint>>"))


def write_collection(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_postings(bag: DataFrame, path: str) -> None:
    """The inverted index, a line for each posting, sorted by entity; a frequent entity takes several files."""
    bag.select("ne", "doc_id", "day", "lang").repartitionByRange("ne", "doc_id").sortWithinPartitions("ne", "doc_id").write.option("sep", "\t").csv(path, compression="gzip")


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("ne string, doc_id long, day int, lang string").option("sep", "\t").csv(path)


def write_dict(rows: DataFrame, key: str, value: str, path: str) -> None:
    """One JSON dictionary of a small table, such as one of countries."""
    pairs = F.map_from_entries(F.collect_list(F.struct(F.col(key).cast("string"), F.col(value))))
    rows.agg(F.to_json(pairs).alias("value")).coalesce(1).write.text(path)


def read_dict(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.text(path).select(F.explode(F.from_json("value", f"map<string, {kind}>")).alias("key", "value"))


def write_arrays(rows: DataFrame, keys: list[str], path: str) -> None:
    """A JSON array for each group of rows, an array a line."""
    rows.groupBy(*keys).agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value")).select("value").write.text(path)


def read_arrays(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)

"""Secret scanning with a random forest, with DataFrame and MLlib functions only.

Candidates are all runs of 20 or more characters that keys and tokens are made
of, and all values of 4 or more characters without blanks that are assigned to
a secret word or stand in quotes after one.  A random forest then tells secrets from the many other long strings.  Its
features are the candidate's length and alphabet, the transitions between
character classes, how much of it dictionary pieces cover, path-like text in
and around it, and the words next to it.  It is trained on labelled findings:
a table of before, candidate, after and label; without one, a table of 2,400
is made by rule from hashes, word pieces and typical surroundings.

Texts are scanned once; documents without a candidate leave at the scan, and a
document's candidates are exploded where it was read, without a shuffle.

Defined results: null and empty texts have no candidates; a candidate's number
counts within its text from 0; rows that repeat an id give their own rows.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
CONTEXT = 40
_SECRET_WORDS = "key token secret password passwd pwd api auth credential bearer private access signing"
#: A value after a secret word (and the rest of its name): assigned, in quotes, or after "bearer".  The short look back comes first, as it is cheap.
_VALUE = (
    r"(?<=[=:\"'`rR]\s{0,3})(?<=(?<![A-Za-z])(?i:" + "|".join(_SECRET_WORDS.split()) + r")(?![A-Za-z])(?:[0-9_-][A-Za-z0-9_-]{0,16})?[\"'`]?\s{0,3}(?:[=:]>?\s{0,3}[\"'`]?|[\"'`])|(?i:bearer)\s{1,3})"
    r"[^\s\"'`=:,;)\]}][^\s\"'`]{2,}[^\s\"'`.,;:)\]}>]"
)
_FOUND = f"{_RUN}|{_VALUE}"

#: Pieces of ordinary words and identifiers.
_PIECES = (
    "tion ing ment ness able ible ance ence ough ight ation ver con pre pro the and for with from that this not "
    "name user file path data test config value index table string number list object class function method "
    "error message request response server client service system process example sample default version module "
    "ung heit keit lich isch sch ein eau elle oire ique ción dad mente ado ido"
).split()
_OTHER_WORDS = "commit sha sha1 sha256 md5 hash checksum digest uuid guid etag revision id integrity example sample dummy placeholder test fixture"


def _without(c: Column, pattern: str) -> Column:
    return F.length(c) - F.length(F.regexp_replace(c, pattern, ""))


def _words(words: str) -> str:
    return r"(?i)(^|[^a-z])(" + "|".join(words.split()) + r")([^a-z]|$)"


def with_features(findings: DataFrame) -> DataFrame:
    """Add the forest's features to rows of before, candidate and after."""
    c, before, after = F.col("candidate"), F.col("before"), F.col("after")
    n = F.length(c).cast("double")
    changes = sum((F.regexp_count(c, F.lit(p)) for p in ("[a-z](?=[0-9])", "[0-9](?=[a-z])", "[A-Z](?=[0-9])", "[0-9](?=[A-Z])", "[a-z](?=[A-Z])")), F.regexp_count(c, F.lit("[A-Z](?=[a-z])")))
    made = {
        "f_length": F.least(n, F.lit(200.0)),
        "f_digits": _without(c, "[0-9]") / n,
        "f_upper": _without(c, "[A-Z]") / n,
        "f_hex": _without(c, "[0-9a-f]") / n,
        "f_signs": _without(c, "[+/_=-]") / n,
        "f_changes": changes / n,
        "f_distinct": F.size(F.array_distinct(F.split(c, ""))) / F.least(n, F.lit(40.0)),
        "f_vowels": _without(c, "[aeiouAEIOU]") / n,
        "f_dictionary": _without(F.lower(c), "(" + "|".join(sorted(_PIECES, key=lambda p: (-len(p), p))) + ")") / n,
        "f_repeats": _without(c, r"(.)\1{2,}") / n,
        "f_path": (c.rlike("/[a-z]") | before.rlike(r"[\w.-]+/[\w.-]*$") | after.rlike(r"^[/.]\w")).cast("double"),
        "f_test_path": F.concat(before, after).rlike(r"(?i)(test|spec|example|fixture|docs?)[/\\.]").cast("double"),
        "f_assigned": before.rlike(r"[=:]\s*[\"'`]?$").cast("double"),
        "f_quoted": (before.rlike("[\"'`]$") & after.rlike("^[\"'`]")).cast("double"),
        "f_secret_word": before.rlike(_words(_SECRET_WORDS)).cast("double"),
        "f_other_word": F.concat_ws(" ", before, after).rlike(_words(_OTHER_WORDS)).cast("double"),
        "f_uuid": c.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$").cast("double"),
    }
    return findings.withColumns({k: v.cast("double") for k, v in made.items()})


FEATURES = [
    "f_length", "f_digits", "f_upper", "f_hex", "f_signs", "f_changes", "f_distinct", "f_vowels", "f_dictionary", "f_repeats",
    "f_path", "f_test_path", "f_assigned", "f_quoted", "f_secret_word", "f_other_word", "f_uuid",
]


def labelled_findings(spark: SparkSession, rows: int = 2400) -> DataFrame:
    """Labelled findings made by rule: half secrets, half strings that only look like some."""
    pick = lambda words, salt: F.element_at(F.array(*(F.lit(w) for w in words)), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(words))) + 1).cast("int"))
    h = F.sha2(F.concat(F.lit("finding"), F.col("id").cast("string")), 256)
    b64 = F.regexp_replace(F.base64(F.unhex(h)), "=", "")
    piece = lambda i: pick(_PIECES, f"p{i}")
    words = F.concat(*(piece(i) for i in range(7)), F.lit("able"))
    secret = [F.substring(h, 1, 40), F.substring(h, 1, 32), h, b64, F.concat(F.lit("sk_live_"), F.substring(b64, 1, 24)), F.concat(F.lit("AKIA"), F.upper(F.substring(h, 1, 16)))]
    secret += [F.substring(h, 1, 16), F.concat(F.initcap(piece(1)), F.substring(h, 1, 2), piece(2), pick("& ! # $ % @ .".split(), "sign"), F.substring(h, 3, 2)), F.concat_ws(".", F.substring(b64, 1, 7), F.substring(b64, 8, 6), F.substring(b64, 14, 9))]
    other = [words, F.concat(piece(1), F.lit("_"), piece(2), F.lit("_"), piece(3), F.lit("_value_"), piece(4), F.lit("_name")), F.concat(F.lit("/usr/"), piece(1), F.lit("/"), piece(2), F.lit("/data/"), words), F.substring(h, 1, 40), F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)), F.rpad(F.lit("x"), 28, "x"), F.lit("=" * 30), F.lit("-" * 40), F.concat(words, F.lit("-"), words), F.concat(F.lit("your-api-key-"), words)]
    #: What else is assigned to a secret word: fixed values, words, names, places to fill in.
    named = [pick("true false null none None undefined string required optional example changeme invalid expired".split(), "v"), F.concat(piece(1), piece(2)), F.concat(F.lit("config."), piece(1), F.lit("_"), piece(2)), F.concat(F.lit("<"), piece(1), F.lit("-"), piece(2)), F.concat(F.lit("${"), piece(1), F.lit("_"), piece(2))]
    other += named
    kind = F.pmod(F.floor(F.col("id") / 2), F.lit(len(other)))
    is_secret = F.pmod("id", F.lit(2)) == 0
    candidate = F.element_at(F.array(*other), (kind + 1).cast("int"))
    digest, assigned = kind.isin(3, 4), kind >= len(other) - len(named)
    secret_before = [' token = "', "api_key: '", 'SECRET_KEY="', " password=", "Authorization: Bearer ", ' auth "', "private key "]
    digest_before = ["commit ", " sha1 = ", "checksum: ", ' id="', "uuid ", "etag: "]
    plain_before = [" ", ". ", "of the ", ' href="', "see src/", "tests/fixtures/", ' name = "', "\n"]
    closes = lambda b: F.when(F.col("before").endswith(b), F.lit(b)).otherwise(F.lit(" "))
    out = spark.range(rows).select(
        F.when(is_secret | assigned, pick(secret_before, "s")).when(digest, pick(digest_before, "d")).otherwise(pick(plain_before, "n")).alias("before"),
        F.when(is_secret, F.element_at(F.array(*secret), (F.pmod(F.floor(F.col("id") / 2), F.lit(len(secret))) + 1).cast("int"))).otherwise(candidate).alias("candidate"),
        is_secret.cast("double").alias("label"),
        F.concat(pick(_PIECES, "w1"), F.lit(" "), pick(_PIECES, "w2")).alias("lead"),
    )
    return out.select(F.concat("lead", "before").alias("before"), "candidate", F.when(F.col("before").endswith('"'), F.lit('" ')).otherwise(closes("'")).alias("after"), "label")


def train(findings: DataFrame, trees: int = 40, depth: int = 8, seed: int = 5) -> RandomForestClassificationModel:
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_features(findings))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(rows)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per candidate: id, number, before, candidate, after."""
    text = F.col("__text")
    rows = docs.select(F.col(id_col), F.col(text_col).alias("__text")).where(text.rlike(_FOUND))
    rows = rows.select(id_col, F.regexp_extract_all(text, F.lit(_FOUND), F.lit(0)).alias("found"), F.split(text, _FOUND, -1).alias("between"))
    between = F.transform("between", lambda x: F.struct(F.right(x, F.lit(CONTEXT)).alias("before"), F.substring(x, 1, CONTEXT).alias("after")))
    each = F.arrays_zip(F.col("found"), F.slice(between, 1, F.size("found")).alias("b"), F.slice(between, 2, F.size("found")).alias("a"))
    rows = rows.select(id_col, F.posexplode(each).alias("number", "x"))
    return rows.select(id_col, "number", F.col("x.b.before").alias("before"), F.col("x.found").alias("candidate"), F.col("x.a.after").alias("after"))


def scan(docs: DataFrame, findings: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", at_least: float = 0.5) -> DataFrame:
    """One row per candidate: id, number, candidate, before, after, score, is_secret."""
    model = train(labelled_findings(docs.sparkSession) if findings is None else findings)
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_features(candidates(docs, id_col, text_col)))
    score = vector_to_array(F.col("probability"))[1]
    return model.transform(rows).select(id_col, "number", "candidate", "before", "after", F.round(score, 6).alias("score"), (score >= at_least).alias("is_secret"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "number", F.length("candidate").cast("long").alias("length"), F.sha2("candidate", 256).alias("candidate_sha256"), "score", "is_secret")


QUERIES = {"op6_secrets": op6_secrets}
ORACLE_SQL: dict[str, str] = {}

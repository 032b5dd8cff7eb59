"""Text columns: tokens, sentences, truncation, cleaning (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_TOKENS = 100
MIN_SENTENCE = 40
#: Lengths of translations relative to English.
TRANSLATION_RATIO = {"en": 1.0, "pl": 0.86, "zh": 1.0, "de": 0.87, "es": 1.13, "fr": 1.1, "ko": 1.0, "pt": 0.99, "ar": 0.9, "ru": 0.89, "tr": 1.0, "it": 1.0}
#: Languages by the engine that finds their entities.
ENTITY_ENGINE = {"polyglot": ("ko", "ar", "tr"), "spacy": ("en", "es", "fr", "zh", "pl", "pt", "de", "ru")}


def clean(text: Column) -> Column:
    """Only letters, digits, underscores and spaces; line breaks go too, so words may merge."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}_ ]", "")


def tokens(text: Column) -> Column:
    """Tokens between single spaces, empty ones included."""
    return F.split(clean(text), " ", -1)


def sentences(text: Column, lang: Column | None = None) -> Column:
    """Distinct trimmed sentences whose text before trimming is longer than 40 characters."""
    text = F.coalesce(text, F.lit(""))
    cut = F.split(text, r"\.", -1)
    if lang is not None:
        cut = F.when(lang == "zh", F.split(text, "。", -1)).otherwise(cut)
    return F.array_distinct(F.transform(F.filter(cut, lambda s: F.length(s) > MIN_SENTENCE), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")))


def truncate(text: Column, length: int = 512, tail: int = 128, compat: bool = False) -> Column:
    """The first ``length - tail`` tokens and the last ``tail``.

    ``compat``: a tail of 0 repeats all tokens, as a slice from -0 does.
    """
    words = tokens(text)
    head = F.slice(words, 1, length - tail)
    end = F.slice(words, -tail, tail) if tail else (words if compat else F.array().cast("array<string>"))
    return F.when(F.size(words) > length, F.array_join(F.concat(head, end), " ")).otherwise(F.array_join(words, " "))


def printable(text: Column) -> Column:
    """Without control, format and unassigned characters and separators other than the space."""
    return F.regexp_replace(text, r"[\p{C}\p{Z}&&[^ ]]", "")


def base_language(lang: Column) -> Column:
    return F.split(lang, "_")[0]


def translation_ratio(lang: Column, compat: bool = False) -> Column:
    """The ratio as an exact decimal, so that 110 tokens are enough in French.

    ``compat``: as a float, where 100 * 1.1 is a little more than 110.
    """
    exact = lambda v: F.lit(v) if compat else F.lit(v).cast("decimal(5,2)")
    pairs = [x for k, v in TRANSLATION_RATIO.items() for x in (F.lit(k), exact(v))]
    return F.coalesce(F.create_map(*pairs)[base_language(lang)], exact(1.0))


def entity_engine(lang: Column) -> Column:
    out = F.lit("wrong language")
    for name, langs in ENTITY_ENGINE.items():
        out = F.when(base_language(lang).isin(*langs), name).otherwise(out)
    return out


def entities(text: Column, lang: Column | None = None) -> Column:
    """Capitalised tokens of two characters or more (any length in Chinese and Korean)."""
    long = lambda w: F.length(w) >= 2 if lang is None else (F.length(w) >= 2) | lang.isin("zh", "ko")
    return F.filter(tokens(text), lambda w: w.rlike(r"^\p{Lu}") & long(w))

"""URL columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Substrings of URLs that aren't news.
BLOCKED = ("sport", "reddit.com", "facebook.com", "twitter.com", "fb.com", "wikipedia.org", "epochtimes.com", "youtube.com", "slideshare.net")


def unify(url: Column) -> Column:
    """A URL without scheme, ``www.`` and final slash; with a query, without its last part and slashes."""
    bare = F.trim(F.coalesce(url, F.lit("")))
    for part in ("https://", "http://", "www."):
        bare = F.replace(bare, F.lit(part), F.lit(""))
    bare = F.when(bare.endswith("/"), F.substring(bare, F.lit(1), F.length(bare) - 1)).otherwise(bare)
    parts = F.split(bare, "/", -1)
    bare = F.when(bare.contains("?"), F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "")).otherwise(bare)
    for c in "+*":
        bare = F.replace(bare, F.lit(c), F.lit("\\" + c))
    return bare


def blocked(url: Column, words: tuple[str, ...] = BLOCKED) -> Column:
    """Whether a URL contains one of the words, case as it is."""
    out = F.lit(False)
    for w in words:
        out = out | url.contains(w)
    return F.coalesce(out, F.lit(False))


def quote(url: Column) -> Column:
    """Percent-encoding as in a query string."""
    return F.url_encode(url)


def host(url: Column) -> Column:
    return F.split(unify(url), "[/?]")[0]

"""URL functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from millrace.session import utrim

# Query parameters that only track.
TRACKING = ["fbclid", "campaign", "source", "tracking"]


def authority(c: Column) -> Column:
    """What stands between "//" and the path, in lower case; empty if there is no scheme."""
    return F.lower(F.regexp_extract(F.coalesce(c, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def url_domain(c: Column) -> Column:
    """Host with its port, without user and "www."."""
    return F.regexp_replace(F.regexp_replace(authority(c), "^.*@", ""), r"^www\.", "")


def norm_domain(c: Column) -> Column:
    """Domain typed as such or as a URL."""
    d = F.regexp_replace(F.lower(utrim(F.coalesce(c, F.lit("")))), "/+$", "")
    d = F.regexp_replace(F.regexp_replace(d, r"^www\.", ""), "^.*@", "")
    return F.when(d.contains("://"), F.coalesce(F.nullif(authority(d), F.lit("")), d)).otherwise(d)


def canonical_url(c: Column) -> Column:
    """Scheme and host in lower case, no "www.", default port, closing slashes, fragment and tracking parameters; order of the others kept. Empty for null."""
    s = utrim(F.coalesce(c, F.lit("")))
    scheme = F.coalesce(F.nullif(F.lower(F.regexp_extract(s, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)), F.lit("")), F.lit("https"))
    host = F.regexp_replace(F.regexp_replace(authority(s), r"^www\.", ""), r":(?:80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(s, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1), "/+$", "")
    query = F.regexp_extract(s, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda kv: (kv != "") & ~F.lower(F.regexp_extract(kv, "^([^=]*)", 1)).rlike(rf"^(?:utm_.*|{'|'.join(TRACKING)})$")), "&")
    return F.when(s == "", "").otherwise(F.concat(scheme, F.lit("://"), host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


# Where the sources' addresses hold the id of a posting, and where any other address may.
POSTING_RULES = {"greenhouse": r"/jobs/(\d{5,})", "lever": r"lever\.co/(?:[\w-]+/)?([a-z0-9-]{8,})(?:/|$|\?)", "remoteok": r"/(\d{4,})[a-z0-9-]*", "adzuna": r"/ad/(\d{4,})", "linkedin": r"/jobs/view/(\d{7,})"}
POSTING_NUMBER = r"/(\d{8,})(?:/|\?|$)"


def posting_id(source: Column, url: Column, given: Column | None = None) -> Column:
    """Posting id by the rule of the source, else the given one, else a long number at the end of the URL."""
    u = F.coalesce(url, F.lit(""))
    own = F.lit("")
    for name, rule in POSTING_RULES.items():
        own = F.when(F.lower(F.coalesce(source, F.lit(""))) == name, F.regexp_extract(u, rule, 1)).otherwise(own)
    last = F.regexp_extract(u, POSTING_NUMBER, 1)
    return F.coalesce(F.nullif(own, F.lit("")), F.nullif(given, F.lit("")) if given is not None else F.lit(None).cast("string"), last)

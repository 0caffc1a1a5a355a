"""Similarities of records: Jaro-Winkler as an Arrow UDF, the rest as Column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F

from millrace.functions.text import jaccard, location_words, normalize_company, shingles, tokens
from millrace.functions.urls import norm_domain, url_domain
from millrace.session import utrim


def jaro_winkler_of(a: str, b: str) -> float:
    """Case-blind Jaro similarity plus a tenth of what is left to 1 for each of up to four equal first letters, whatever the similarity. 1 for equal texts, 0 if one is empty."""
    a, b = (a or "").lower(), (b or "").lower()
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free: dict[str, list[int]] = {}
    for j, c in enumerate(b):
        free.setdefault(c, []).append(j)
    left, right = [], []
    for i, c in enumerate(a):
        # the first free place of this letter within reach
        places = free.get(c, ())
        for k, j in enumerate(places):
            if j > i + reach:
                break
            if j >= i - reach:
                left.append(c)
                right.append(places.pop(k))
                break
    m = len(left)
    if not m:
        return 0.0
    turned = sum(c != b[j] for c, j in zip(left, sorted(right))) // 2
    jaro = (m / len(a) + m / len(b) + (m - turned) / m) / 3.0
    head = 0
    while head < min(4, len(a), len(b)) and a[head] == b[head]:
        head += 1
    return jaro + head * 0.1 * (1.0 - jaro)


def _jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    # within a block the same texts meet again and again
    known = {p: jaro_winkler_of(*p) for p in set(zip(a, b))}
    return pd.Series([known[p] for p in zip(a, b)], dtype="float64")


def jaro_winkler(a: Column | str, b: Column | str) -> Column:
    """jaro_winkler_of, a batch at a time; put it behind blocking."""
    return F.pandas_udf(_jaro_winkler, "double")(a, b)


def description_similarity(a: Column, b: Column) -> Column:
    """Share of common shingles; half where one text is missing."""
    return F.when((F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == ""), 0.5).otherwise(jaccard(shingles(a), shingles(b)))


def location_similarity(a: Column, b: Column, words: list[Column] | None = None) -> Column:
    """words: the distinct words of both places, if they are worked out already."""
    x, y = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    words = words or [F.array_distinct(tokens(location_words(c))) for c in (x, y)]
    return F.when((x == "") & (y == ""), 1.0).when((x == "") | (y == ""), 0.5).when(F.lower(utrim(x)) == F.lower(utrim(y)), 1.0).otherwise(jaccard(*words))


def company_terms(name: tuple[Column, Column], domain: tuple[Column, Column], url: tuple[Column, Column]) -> dict[str, Column]:
    """Columns n1, n2 (names), d1, d2 (domains), u1, u2 (domains of the URLs) of both sides."""
    n = [normalize_company(c) for c in name]
    u = [norm_domain(url_domain(c)) for c in url]
    d = [F.coalesce(F.nullif(norm_domain(c), F.lit("")), x) for c, x in zip(domain, u)]
    return dict(zip(("n1", "n2", "d1", "d2", "u1", "u2"), (*n, *d, *u)))


def company_score(jw: Column) -> Column:
    """From the columns of company_terms and the similarity of the names: 0.45 name, 0.35 domain, 0.20 URL, unknown ones half; like names with one domain count 0.95 at least, with two 0.55 at most."""
    name = F.when((F.col("n1") != "") & (F.col("n2") != ""), jw).when((F.col("n1") == "") & (F.col("n2") == ""), 1.0).otherwise(0.5)

    def same(a: str, b: str) -> Column:
        return F.when((F.col(a) == "") | (F.col(b) == ""), 0.5).when(F.col(a) == F.col(b), 1.0).otherwise(0.0)

    c = 0.45 * name + 0.35 * same("d1", "d2") + 0.20 * same("u1", "u2")
    sure = (F.col("n1") != "") & (F.col("n2") != "") & (name >= 0.90) & (F.col("d1") != "") & (F.col("d2") != "")
    return F.when(sure & (F.col("d1") == F.col("d2")), F.greatest(c, F.lit(0.95))).when(sure, F.least(c, F.lit(0.55))).otherwise(c)

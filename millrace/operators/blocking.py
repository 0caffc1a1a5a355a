"""Blocking keys, candidate pairs and the composite similarity of records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions.similarity import company_score, company_terms, description_similarity, jaro_winkler, location_similarity
from millrace.functions.text import jaccard, location_bucket, location_words, normalize_company, shingles, title_stem, tokens
from millrace.functions.urls import norm_domain, url_domain
from millrace.session import cut, utrim

# Floor of the titles, scores of a merge and of a review, score of one company.
TITLE_FLOOR, HIGH, REVIEW, SAME_COMPANY = 0.75, 0.88, 0.80, 0.60


def blocking_keys(df: DataFrame, given_id: str | None = "posting_id") -> Column:
    """Array of up to five keys; those with an empty part are left out."""
    company, stem, bucket = normalize_company(F.col("company")), title_stem(F.col("title")), location_bucket(F.col("location"))
    raw = F.coalesce(F.nullif(F.col("employer_domain"), F.lit("")), url_domain(F.col("apply_url_direct")))
    domain = norm_domain(raw)
    own = utrim(F.coalesce(F.col(given_id), F.lit(""))) if given_id else F.lit("")
    keys = [
        F.when((company != "") & (stem != ""), F.concat_ws("|", company, stem)),
        F.when((company != "") & (bucket != ""), F.concat_ws("|", company, bucket)),
        F.when((domain != "") & (stem != ""), F.concat_ws("|", domain, stem)),
        F.when(own != "", own),
        F.when((domain != "") & (stem != ""), F.concat(F.lit("apply:"), domain, F.lit("|"), stem)),
    ]
    return F.array_compact(F.array(*keys))


def candidates(left: DataFrame, right: DataFrame, left_id: str, right_id: str, tiers: list[Column]) -> DataFrame:
    """left_id, right_id, tier: pairs equal in a key of one of the tiers (arrays of strings, from column names both sides have), with the first such tier.

    Each tier's keys carry its number, so one equi-join serves all of them; a hot key is split by AQE's skew join.
    """

    def keyed(df: DataFrame, ident: str) -> DataFrame:
        entries = [F.arrays_zip(F.array_repeat(F.lit(n), F.size(c)).alias("tier"), c.alias("k")) for n, c in enumerate(tiers)]
        return df.select(ident, F.inline(F.concat(*entries))).where("k is not null and k <> ''").dropDuplicates()

    a, b = keyed(left, left_id), keyed(right, right_id)
    return a.join(b, ["tier", "k"]).groupBy(left_id, right_id).agg(F.min("tier").alias("tier"))


def met(left: DataFrame, right: DataFrame, tiers: list[Column], fields: tuple[DataFrame, DataFrame], ready: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """Pairs as ``candidates`` finds them, each once, with tier and what ``ready`` makes of the fields of both sides.

    left and right: id1 and id2 with the columns of the tiers; fields: id1 and id2 with the columns that ready takes. Ids
    meet first: of the keys that a pair has in common the first one yields it, and only under such a key do whole rows
    travel, so no pair is shuffled. Keys are compared by 64-bit hashes; a hot key is split by AQE's skew join.
    """

    def keyed(df: DataFrame, i: int) -> DataFrame:
        hashed = []
        for n, c in enumerate(tiers):
            tier = F.lit(n)
            hashed.append(F.transform(F.filter(c, lambda k: k.isNotNull() & (k != "")), lambda k: F.xxhash64(tier, k)))  # noqa: B023
        ks = df.select(f"id{i}", F.array_distinct(F.concat(*hashed)).alias(f"ks{i}"), F.array(*[F.size(F.array_distinct(F.concat(*hashed[: n + 1]))) for n in range(len(tiers))]).alias("ends"))
        # the tier of a key, from its place among the row's keys
        ks = ks.select("*", F.posexplode(f"ks{i}").alias("pos", "k")).select(f"id{i}", f"ks{i}", "k", F.size(F.filter("ends", lambda e: e <= F.col("pos"))).alias("tier"))
        return ks if i == 1 else ks.drop("tier")

    first = F.array_intersect("ks1", "ks2")[0] == F.col("k")
    ids = keyed(left, 1).join(keyed(right, 2), "k").where(first)
    entries = [F.struct(F.lit(i).alias("side"), F.col(f"id{i}").alias("id"), "k", F.col(f"ks{i}").alias("ks"), "tier") for i in (1, 2)]
    needed = cut(ids.select(F.inline(F.array(*entries))).distinct())
    sides = []
    for i in (1, 2):
        mine = needed.where(F.col("side") == i).groupBy(F.col("id").alias(f"id{i}")).agg(F.collect_list(F.struct("k", F.col("ks").alias(f"ks{i}"), *["tier"][: 2 - i])).alias("e"))
        sides.append(ready(fields[i - 1].join(mine, f"id{i}"), i).select("*", F.explode("e").alias("x")).select("*", "x.*").drop("e", "x"))
    return sides[0].join(sides[1], "k").where(first).drop("k", "ks1", "ks2")


FIELDS = ["title", "company", "location", "description", "employer_domain", "apply_url_direct"]
SIDE = ["title", "n", "d", "u", "location", "words", "shingles"]


def terms(df: DataFrame, side: int) -> DataFrame:
    """df with what the score needs of each record, worked out once, in the place of FIELDS: columns of SIDE followed by 1 or 2."""
    n, d, u = (list(company_terms(*[(F.col(c), F.col(c)) for c in ("company", "employer_domain", "apply_url_direct")]).values())[i] for i in (0, 2, 4))
    hashed = F.when(F.coalesce("description", F.lit("")) != "", F.transform(shingles(F.col("description")), lambda s: F.xxhash64(s)))
    columns = [F.col("title"), n, d, u, F.col("location"), F.array_distinct(tokens(location_words(F.col("location")))), hashed]
    return df.select(*[c for c in df.columns if c not in FIELDS], *[c.alias(f"{name}{side}") for name, c in zip(SIDE, columns)])


def scored_terms(pairs: DataFrame) -> DataFrame:
    """As ``scored``, of the columns of ``terms``."""
    described = F.when(F.col("shingles1").isNull() | F.col("shingles2").isNull(), 0.5).otherwise(jaccard(F.col("shingles1"), F.col("shingles2")))
    located = location_similarity(F.col("location1"), F.col("location2"), [F.col("words1"), F.col("words2")])
    # behind a generator: else the shingles of each pair are held while Python works out its names
    pairs = pairs.select("*", F.explode(F.array(F.struct(described.alias("described"), located.alias("located")))).alias("x")).drop(*[f"{c}{i}" for c in ("location", "words", "shingles") for i in (1, 2)])
    return _rated(pairs, F.col("x.located"), F.col("x.described"))


def scored(pairs: DataFrame) -> DataFrame:
    """pairs (columns title1, company1, location1, description1, employer_domain1, apply_url_direct1 and the same with 2) with score and verdict.

    0.35 title, 0.25 company, 0.15 location, 0.25 description. auto_merge needs a high score, like companies and no
    contradicting domains; nothing is said below the floor of the title.
    """
    both = lambda c: (F.col(f"{c}1"), F.col(f"{c}2"))
    p = pairs.withColumns(company_terms(both("company"), both("employer_domain"), both("apply_url_direct")))
    return _rated(p, location_similarity(*both("location")), description_similarity(*both("description")))


def _rated(p: DataFrame, location: Column, description: Column) -> DataFrame:
    p = p.withColumns({"jw_title": jaro_winkler("title1", "title2"), "jw_company": jaro_winkler("n1", "n2")})
    p = p.withColumn("c_company", company_score(F.col("jw_company")))
    p = p.withColumn("score", 0.35 * F.col("jw_title") + 0.25 * F.col("c_company") + 0.15 * location + 0.25 * description)
    against = (F.col("d1") != "") & (F.col("d2") != "") & (F.col("d1") != F.col("d2")) & (F.col("n1") != "") & (F.col("n2") != "") & (F.col("jw_company") >= 0.60)
    verdict = F.when(F.col("jw_title") < TITLE_FLOOR, "none").when((F.col("score") >= HIGH) & (F.col("c_company") >= SAME_COMPANY) & ~against, "auto_merge").when(F.col("score") >= REVIEW, "review").otherwise("none")
    return p.withColumn("verdict", verdict).drop("n1", "n2", "d1", "d2", "u1", "u2")

"""What a profile asks for: projection of raw postings, the profile's filter, and relevance scores.

All of them are Column expressions in which the profile's terms are literals: one scan, no join, and no shuffle.
The rules for places and salaries are left out.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions.dates import dated, freshness
from millrace.functions.similarity import location_similarity
from millrace.functions.text import any_term, experience, identity_hash, normalize_text, skill, tokens
from millrace.session import is_blank

# Sources whose companies an allowlist restricts, which sources are on by default, their authority.
ALLOWLISTED = ("greenhouse", "lever", "career_page_generic", "career_page_browser")
OFF_BY_DEFAULT = ("linkedin", "indeed", "glassdoor")
AUTHORITY = {
    "greenhouse": 5, "lever": 5, "usajobs": 5, "adzuna": 5, "career_page_generic": 4, "career_page_browser": 4, "google_jobs": 3, "remoteok": 2,
    "weworkremotely": 2, "remotive": 2, "jobicy": 2, "linkedin_guest": 2, "linkedin": 0, "indeed": 0, "glassdoor": 0, "naukri": 0, "internshala": 0, "hirist": 0, "wellfound": 0,
}


@dataclass
class Profile:
    """What is looked for. Unknown keys of a mapping are passed over; a source that isn't named keeps its default."""

    name: str = "default"
    roles: list[str] = field(default_factory=list)
    keywords: list[str] = field(default_factory=list)
    excludes: list[str] = field(default_factory=list)
    location: str = ""
    remote: bool = True
    seniority: str = ""
    greenhouse_boards: list = field(default_factory=list)
    lever_boards: list = field(default_factory=list)
    career_pages: list = field(default_factory=list)
    company_allowlist: list = field(default_factory=list)
    sources: dict[str, bool] = field(default_factory=dict)
    top_n: int = 50

    @classmethod
    def of(cls, given: dict) -> Profile:
        """From a mapping, as a profile file holds it. An old allowlist stands for boards and pages where those aren't given."""
        data = dict(given)
        data["sources"] = {s: s not in OFF_BY_DEFAULT for s in AUTHORITY} | (data.get("sources") or {})
        if not {"greenhouse_boards", "lever_boards", "career_pages"} & set(data):
            names = [str(x.get("board") or x.get("slug") or x.get("company") or "") if isinstance(x, dict) else x for x in data.get("company_allowlist") or []]
            data["greenhouse_boards"] = data["lever_boards"] = [n for n in names if n]
            data["career_pages"] = [x for x in data.get("company_allowlist") or [] if isinstance(x, dict) and x.get("url")]
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in data.items() if k in known and v is not None})

    @classmethod
    def load(cls, path: str) -> Profile:
        """From a JSON or, where that package is installed, YAML file."""
        with open(path, encoding="utf-8") as f:
            text = f.read()
        try:
            import yaml
        except ImportError:
            import json

            return cls.of(json.loads(text))
        return cls.of(yaml.safe_load(text) or {})

    def allowed(self) -> list[str]:
        """Lower-cased companies of the allowlist."""
        pages = [p.get("company") if isinstance(p, dict) else None for p in self.career_pages]
        old = [c.get("company") if isinstance(c, dict) else c for c in self.company_allowlist]
        return sorted({str(x).lower() for x in (*self.greenhouse_boards, *self.lever_boards, *pages, *old) if x})

    def query_terms(self) -> list[str]:
        """Words of roles and keywords, each once, in order; the normalisation of the texts they are looked up in."""
        words = [w for t in (*self.roles, *self.keywords) for w in "".join(c for c in " ".join(str(t).lower().split()) if c in " abcdefghijklmnopqrstuvwxyz0123456789").split()]
        return list(dict.fromkeys(words))


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def postings(raw: DataFrame, as_of: Column | None = None) -> DataFrame:
    """raw with the columns of a posting: role, remote, experience_needed, salary_if_present, seniority, valid_through, job_id_hash and, with ``as_of`` (microseconds), date_posted, freshness and missing_fields.

    Extras fill what the posting itself doesn't state. Null texts count as empty.
    """
    extra = lambda k: F.coalesce(F.try_element_at("extra", F.lit(k)), F.lit(""))
    low = F.lower(_text("location")).contains("remote") | F.lower(_text("description")).contains("remote")
    out = raw.withColumns({c: _text(c) for c in ("title", "company", "location", "description")}).withColumn("apply_url_direct", _text("apply_url"))
    out = out.withColumns(
        {
            "role": F.col("title"), "remote": low | (extra("remote") != ""), "experience_needed": F.when(extra("experience_needed") != "", extra("experience_needed")).otherwise(experience(F.col("description"))),
            "salary_if_present": extra("salary"), "seniority": extra("seniority"), "valid_through": extra("valid_through"), "job_id_hash": identity_hash(F.col("title"), F.col("company"), F.col("location")),
        }
    )
    if as_of is None:
        return out
    out = dated(out.withColumnRenamed("posted_date", "posted_at"), "posted_at", "__at")
    out = out.withColumns({"date_posted": F.col("__at_date"), "freshness": freshness(F.col("__at_date"), F.col("__at_micros"), as_of)})
    marks = [F.when(F.coalesce(F.col(c), F.lit("")).isin("", "MISSING"), F.lit(c)) for c in ("title", "company", "apply_url_direct", "date_posted")]
    return out.withColumn("missing_fields", F.array_compact(F.array(*marks))).drop("__at_date", "__at_micros")


def titled(rows: DataFrame) -> DataFrame:
    """Without rows that have no title."""
    return rows.where(~_text("title").isin("", "MISSING"))


def accepts(profile: Profile) -> Column:
    """Whether a posting (title, role, description, seniority, company, source_name) passes a profile: excluded terms, roles, keywords, seniority and allowlist.

    Keywords are not asked of a posting without description. What can't be decided (null) passes.
    """
    hay = F.concat_ws(" ", _text("title"), _text("role"), _text("description"))
    out = F.lit(True)
    if profile.excludes:
        out = out & ~any_term(hay, profile.excludes)
    if profile.roles:
        out = out & any_term(hay, profile.roles)
    if profile.keywords:
        out = out & (any_term(hay, profile.keywords) | (F.trim(_text("description")) == ""))
    if profile.seniority:
        own = F.lower(_text("seniority"))
        out = out & ((own == "") | own.contains(profile.seniority.lower()))
    names = profile.allowed()
    if names:
        company = F.lower(_text("company"))
        listed = F.exists(F.array(*[F.lit(n) for n in names]), lambda n: company.contains(n))
        out = out & (~F.col("source_name").isin(*ALLOWLISTED) | listed)
    return F.coalesce(out, F.lit(True))


def likely(profile: Profile) -> Column:
    """Whether title or company hint at the profile: such rows come first where a budget bounds what is looked at closely."""
    hay = F.lower(F.concat_ws(" ", _text("title"), _text("company")))
    out = F.lit(False)
    for term in (*profile.roles, *profile.keywords):
        out = out | hay.contains(term.lower())
    return out


def of_sources(rows: DataFrame, profile: Profile, only: list[str] | None = None) -> DataFrame:
    """Rows of the sources that the profile switches on, and that are named in ``only``."""
    on = sorted(s for s, use in profile.sources.items() if use and (only is None or s in only))
    return rows.where(F.col("source_name").isin(*on)) if on else rows.where(F.lit(False))


def first_of_each(rows: DataFrame, by: str, order: list[str], n: int) -> DataFrame:
    """The first n rows of each value of ``by``. Each task keeps n of each value before anything is shuffled, so a hot value costs no more than another."""
    entry = F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], F.struct(*rows.columns).alias("row"))
    lot = F.spark_partition_id()
    some = rows.groupBy(F.col(by).alias("b"), lot.alias("lot")).agg(F.slice(F.array_sort(F.collect_list(entry)), 1, n).alias("e"))
    return some.groupBy("b").agg(F.slice(F.array_sort(F.flatten(F.collect_list("e"))), 1, n).alias("e")).select(F.explode("e").alias("e")).select("e.row.*")


def bm25(terms: list[str], words: Column, k1: float = 1.5, b: float = 0.75, avgdl: Column | None = None, idf: Column | None = None) -> Column:
    """BM25 of an array of words for the terms; a term that is asked twice counts twice.

    avgdl: mean number of words of a text, by default the text's own; idf: map of weights, 1 for terms it doesn't hold.
    The words are bound once in a lambda, so they aren't worked out for each term.
    """
    if not terms:
        return F.lit(0.0)

    def score(w: Column) -> Column:
        n = F.size(w)
        norm = F.lit(k1) if avgdl is None else k1 * (1 - b + b * n / avgdl)

        def part(q: Column) -> Column:
            f = F.size(F.filter(w, lambda x: x == q))
            weight = F.lit(1.0) if idf is None else F.coalesce(F.try_element_at(idf, q), F.lit(1.0))
            return F.when(f > 0, weight * f * (k1 + 1) / (f + norm)).otherwise(0.0)

        return F.aggregate(F.array(*[F.lit(t) for t in terms]), F.lit(0.0), lambda a, q: a + part(q))

    return F.transform(F.array(words), score)[0]


def bm25_coverage(terms: list[str], words: Column) -> Column:
    """BM25 as a share of the terms, 1 at most."""
    return F.least(F.lit(1.0), bm25(terms, words) / max(1, len(terms)))


def skill_overlap(profile: Profile, words: Column, stated: Column | None = None) -> Column:
    """Share of the profile's skills that stand among the words, or among the stated keywords; half if the profile names none."""
    want = F.array_except(F.array_distinct(F.array(*[skill(F.lit(str(k))) for k in profile.keywords])), F.array(F.lit(""))) if profile.keywords else None
    if want is None:
        return F.lit(0.5)
    have = F.transform(words if stated is None else F.concat(words, F.coalesce(stated, F.array().cast("array<string>"))), skill)
    return F.when(F.size(want) == 0, 0.5).otherwise(F.coalesce(F.try_divide(F.size(F.array_intersect(want, have)), F.size(want)), F.lit(0.0)))


def experience_compat(profile: Profile) -> Column:
    if not profile.seniority:
        return F.lit(0.5)
    have = F.lower(_text("seniority"))
    return F.when(have == "", 0.5).when(have.contains(profile.seniority.lower()), 1.0).otherwise(0.0)


def location_compat(profile: Profile) -> Column:
    """1 if a remote posting is wanted and this is one, or if it is at a like place; 0 if not; half if nothing is asked."""
    if profile.remote:
        return F.when(F.coalesce(F.col("remote"), F.lit(False)) | F.lower(_text("location")).contains("remote"), 1.0).otherwise(0.0)
    if profile.location:
        return F.when(location_similarity(F.col("location"), F.lit(profile.location)) >= 0.5, 1.0).otherwise(0.0)
    return F.lit(0.5)


def scores(rows: DataFrame, profile: Profile) -> DataFrame:
    """rows with title_cover, text_cover, skill_overlap, experience_compat, location_compat and match_score.

    0.6 relevance (0.6 title, 0.4 description; half without terms), 0.2 skills, 0.1 experience, 0.1 place, within [0, 1].
    Title and description are cut into words once, behind a generator.
    """
    terms = profile.query_terms()
    cut = F.struct(tokens(normalize_text(F.col("title"))).alias("t"), tokens(normalize_text(F.col("description"))).alias("d"))
    out = rows.select("*", F.explode(F.array(cut)).alias("__w"))
    out = out.withColumns(
        {
            "title_cover": bm25_coverage(terms, F.col("__w.t")), "text_cover": bm25_coverage(terms, F.col("__w.d")),
            "skill_overlap": skill_overlap(profile, F.concat("__w.t", "__w.d")), "experience_compat": experience_compat(profile), "location_compat": location_compat(profile),
        }
    )
    relevance = 0.6 * F.col("title_cover") + 0.4 * F.col("text_cover") if terms else F.lit(0.5)
    total = 0.6 * relevance + 0.2 * F.col("skill_overlap") + 0.1 * F.col("experience_compat") + 0.1 * F.col("location_compat")
    return out.withColumn("match_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))).drop("__w")


def job_state(status: Column, url: Column) -> Column:
    return F.when(status.eqNullSafe("CLOSED"), "closed").when(is_blank(url), "invalid_url").otherwise("open")


def authority(source: Column) -> Column:
    """Authority of a source, 1 for unknown ones."""
    table = F.create_map(*[F.lit(x) for kv in AUTHORITY.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(F.coalesce(source, F.lit("")))), F.lit(1))

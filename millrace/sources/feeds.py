"""Landed payloads of feeds as rows of one schema: one projection for each kind of feed.

Payloads are files that something else fetched: JSON bodies, RSS items, pages with embedded JSON-LD, lists of HTML cards. Each
function takes a DataFrame with ``payload`` (the body) and ``source_url`` and gives RAW columns; bodies that don't parse
give no rows. All but the JSON-LD walk are built-in expressions.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.functions.dates import age_phrase

RAW = "source_name string, source_url string, title string, company string, location string, description string, posted_date string, apply_url string, extra map<string,string>"
RAW_COLUMNS = [c.split()[0] for c in RAW.split(", ")]


def _raw(df: DataFrame, source: str, extra: dict[str, Column] | None = None, **columns: Column) -> DataFrame:
    """RAW rows; empty texts stay, missing columns are null, extras that are null or empty are left out of the map."""
    pairs = [F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in (extra or {}).items()]
    held = F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["v"].isNotNull() & (p["v"] != ""))) if pairs else F.create_map().cast("map<string,string>")
    given = {"source_name": F.lit(source), "source_url": F.col("source_url"), "extra": held} | columns
    return df.select(*[given.get(c, F.lit(None).cast("string")).alias(c) for c in RAW_COLUMNS])


def _items(df: DataFrame, schema: str, path: str | None = None) -> DataFrame:
    """One row per object of a JSON array that is the body, or stands under a key of it."""
    kind = f"array<struct<{schema}>>" if path is None else f"struct<{path}: array<struct<{schema}>>>"
    body = F.from_json("payload", kind)
    return df.select("source_url", F.explode(body if path is None else body[path]).alias("j"))


def slug_json(df: DataFrame, base: str = "https://remoteok.com") -> DataFrame:
    """A JSON array of postings with a slug; other objects (a legal notice) are left out. Relative URLs get the base."""
    j = _items(df, "slug: string, id: string, company: string, position: string, title: string, tags: array<string>, description: string, url: string, date: string, location: string, salary: string, logo: string").where("j.slug is not null")
    url = F.when(F.col("j.url").startswith("/"), F.concat(F.lit(base), F.col("j.url"))).otherwise(F.col("j.url"))
    extra = {"tags": F.when(F.size("j.tags") > 0, F.to_json("j.tags")), "salary": F.col("j.salary"), "logo": F.col("j.logo")}
    return _raw(j, "remoteok", extra, title=F.coalesce(F.nullif("j.position", F.lit("")), "j.title"), company=F.col("j.company"), location=F.col("j.location"), description=F.col("j.description"), posted_date=F.col("j.date"), apply_url=url)


# Names that a search API's country codes stand for.
COUNTRIES = {
    "in": "India", "us": "USA", "gb": "UK", "ca": "Canada", "au": "Australia", "nz": "New Zealand", "mx": "Mexico", "br": "Brazil", "de": "Germany",
    "fr": "France", "sg": "Singapore", "ae": "UAE", "za": "South Africa", "nl": "Netherlands", "es": "Spain", "it": "Italy", "ie": "Ireland", "pl": "Poland",
}


def search_json(df: DataFrame, country: str = "") -> DataFrame:
    """``results`` of a search API; the country (a code or a name) is added to a place that doesn't name it."""
    country = COUNTRIES.get(country.lower(), country)
    j = _items(df, "title: string, company: struct<display_name: string, displayname: string>, location: struct<display_name: string, displayname: string>, description: string, created: string, redirect_url: string, url: string, salary_min: string", "results")
    place = F.coalesce("j.location.displayname", "j.location.display_name", F.lit(""))
    full = F.when(F.lower(place).contains(country.lower()), place).otherwise(F.concat_ws(", ", F.nullif(place, F.lit("")), F.lit(country))) if country else place
    return _raw(j, "adzuna", {"salary": F.col("j.salary_min")}, title=F.col("j.title"), company=F.coalesce("j.company.displayname", "j.company.display_name"), location=full, description=F.col("j.description"), posted_date=F.col("j.created"), apply_url=F.coalesce(F.nullif("j.redirect_url", F.lit("")), "j.url"))


def government_json(df: DataFrame) -> DataFrame:
    """Nested search result of a government portal; the first apply URI counts."""
    inner = "MatchedObjectDescriptor: struct<PositionTitle: string, OrganizationName: string, PositionLocationDisplay: string, QualificationSummary: string, PublicationStartDate: string, ApplyURI: array<string>, PositionURI: string, PositionRemuneration: array<struct<MinimumRange: string, MaximumRange: string>>>"
    body = F.from_json("payload", f"struct<SearchResult: struct<SearchResultItems: array<struct<{inner}>>>>")
    j = df.select("source_url", F.explode(body["SearchResult"]["SearchResultItems"]).alias("i")).select("source_url", F.col("i.MatchedObjectDescriptor").alias("j"))
    pay = F.get(F.col("j.PositionRemuneration"), F.lit(0))
    return _raw(j, "usajobs", {"salary_min": pay["MinimumRange"], "salary_max": pay["MaximumRange"]}, title=F.col("j.PositionTitle"), company=F.col("j.OrganizationName"), location=F.col("j.PositionLocationDisplay"), description=F.col("j.QualificationSummary"), posted_date=F.col("j.PublicationStartDate"), apply_url=F.coalesce(F.get("j.ApplyURI", F.lit(0)), "j.PositionURI"))


def board_json(df: DataFrame, site: str = "https://boards.greenhouse.io") -> DataFrame:
    """Postings of one employer's board (column ``board``): the company is the board's name in title case, the apply URL the board's with the posting's id.

    Departments stand as objects, ids into the body's list, or names.
    """
    job = "struct<id: string, title: string, location: struct<name: string>, offices: array<struct<name: string>>, content: string, updated_at: string, absolute_url: string, departments: array<string>>"
    body = F.from_json("payload", f"struct<departments: array<struct<id: string, name: string>>, jobs: array<{job}>>")
    j = df.select("source_url", "board", body.alias("b")).select("source_url", "board", F.map_from_entries(F.coalesce("b.departments", F.array().cast("array<struct<id:string,name:string>>"))).alias("held"), F.explode("b.jobs").alias("j"))
    offices = F.array_join(F.filter(F.col("j.offices.name"), lambda n: n.isNotNull() & (n != "")), ", ")

    def department(d: Column) -> Column:
        given = F.from_json(d, "struct<id: string, name: string>")
        known = F.try_element_at(F.col("held"), F.coalesce(given["id"], d))
        return F.when(d.startswith("{"), F.coalesce(given["name"], known, F.lit(""))).otherwise(F.coalesce(known, F.when(d.rlike(r"^\d+$"), "").otherwise(d)))

    departments = F.when(F.size("j.departments") > 0, F.to_json(F.transform("j.departments", department)))
    return _raw(
        j, "greenhouse", {"departments": departments, "job_id": F.col("j.id")}, title=F.col("j.title"), company=F.initcap(F.replace("board", F.lit("-"), F.lit(" "))),
        location=F.coalesce(F.nullif("j.location.name", F.lit("")), offices), description=F.col("j.content"), posted_date=F.col("j.updated_at"),
        apply_url=F.concat(F.lit(site + "/"), "board", F.lit("#"), F.coalesce("j.id", F.lit(""))), source_url=F.coalesce("j.absolute_url", F.lit("")),
    )


def posting_json(df: DataFrame) -> DataFrame:
    """A JSON array of an employer's postings with categories; a missing place means remote. The description is the plain text of an object, else empty."""
    kind = "array<struct<id: string, text: string, hostedUrl: string, createdAt: string, description: string, categories: struct<location: string, commitment: string>>>"
    j = df.select("source_url", "board", F.explode(F.from_json("payload", kind)).alias("j"))
    url = F.coalesce("j.hostedUrl", F.lit(""))
    plain = F.from_json("j.description", "struct<plain: string>")["plain"]
    return _raw(
        j, "lever", {"job_id": F.col("j.id"), "commitment": F.col("j.categories.commitment")}, title=F.col("j.text"), company=F.initcap(F.replace(F.trim("board"), F.lit("-"), F.lit(" "))),
        location=F.coalesce(F.nullif("j.categories.location", F.lit("")), F.lit("Remote")), description=F.coalesce(plain, F.lit("")), posted_date=F.col("j.createdAt"), apply_url=url, source_url=url,
    )


def rss_items(spark: SparkSession, path: str, source: str, company_first: bool = False) -> DataFrame:
    """Items of RSS files. The company is the author; else the title is cut: "Company: Role" or "Company - Role"."""
    schema = "title string, link string, description string, pubDate string, author string"
    items = spark.read.format("xml").option("rowTag", "item").schema(schema).load(path).withColumn("source_url", F.lit(path))
    author = F.nullif(F.trim(F.coalesce("author", F.lit(""))), F.lit(""))
    if company_first:
        head = F.nullif(F.trim(F.regexp_extract("title", r"^([^:]*):", 1)), F.lit(""))
        title = F.when(F.col("title").contains(":"), F.trim(F.regexp_extract("title", r"^[^:]*:(.*)$", 1))).otherwise(F.col("title"))
    else:
        head, title = F.nullif(F.trim(F.regexp_extract("title", r"^(.+?)\s+[-–]\s+", 1)), F.lit("")), F.col("title")
    return _raw(items, source, None, title=title, company=F.coalesce(author, head, F.lit("")), location=F.lit("Remote"), description=F.col("description"), posted_date=F.col("pubDate"), apply_url=F.col("link"))


def html_cards(df: DataFrame, source: str = "linkedin_guest", default_place: str = "") -> DataFrame:
    """Cards of a result list: one row per list element that has a title and a link."""
    card = df.select("source_url", F.explode(F.split("payload", r"(?i)<li\b")).alias("c"))

    def inner(tag: str, mark: str) -> Column:
        return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract("c", rf'(?is)<{tag}[^>]*class="[^"]*{mark}[^"]*"[^>]*>(.*?)</{tag}>', 1), "<[^>]+>", " "), r"(?U)\s+", " "))

    href = F.replace(F.regexp_extract("c", r'(?i)<a[^>]+href="([^"]+)"', 1), F.lit("&amp;"), F.lit("&"))
    place = inner("span", "location")
    rows = _raw(card, source, None, title=inner("h3", "title"), company=inner("h4", "subtitle"), location=F.when(place != "", place).otherwise(F.lit(default_place)), posted_date=F.regexp_extract("c", r'(?i)<time[^>]+datetime="([^"]+)"', 1), apply_url=href)
    return rows.where("title <> '' and apply_url <> ''")


_SCRIPT = re.compile(r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>""")


def _first(v) -> str:
    """A JSON value as text: the first of a list, the name or value of an object."""
    while isinstance(v, list):
        v = v[0] if v else ""
    if isinstance(v, dict):
        return next((_first(v[k]) for k in ("name", "@value", "value") if v.get(k)), "")
    return "" if v is None else str(v)


def _walk(node) -> Iterator[dict]:
    """The job postings in a JSON-LD document, graphs and lists included."""
    if isinstance(node, list):
        for n in node:
            yield from _walk(n)
    elif isinstance(node, dict):
        kind = node.get("@type")
        if "JobPosting" in (kind if isinstance(kind, list) else [kind]):
            yield node
        yield from _walk(node.get("@graph"))


def posting_of(node: dict) -> dict:
    def under(n, key):
        if isinstance(n, list):
            n = n[0] if n else {}
        return n.get(key) if isinstance(n, dict) else None

    address = under(node.get("jobLocation"), "address")
    place = ", ".join(x for x in (_first(under(address, k)) for k in ("addressLocality", "addressRegion", "addressCountry")) if x) if not isinstance(address, str) else address
    pay = node.get("baseSalary")
    value, currency = under(pay, "value"), _first(under(pay, "currency"))
    low, high = _first(under(value, "minValue")), _first(under(value, "maxValue"))
    salary = f"{low}-{high} {currency}".strip() if low and high else f"{_first(value)} {currency}".strip() if _first(value) else ""
    remote = _first(node.get("jobLocationType")).upper() == "TELECOMMUTE"
    extra = {"valid_through": _first(node.get("validThrough")), "employment_type": _first(node.get("employmentType")), "salary": salary, "remote": "true" if remote else "", "qualifications": _first(node.get("qualifications")), "same_as": _first(under(node.get("hiringOrganization"), "sameAs"))}
    return {"title": _first(node.get("title")), "company": _first(node.get("hiringOrganization")), "location": place or ("Remote" if remote else ""), "description": _first(node.get("description")), "posted_date": _first(node.get("datePosted")), "apply_url": _first(node.get("url")), "extra": {k: v for k, v in extra.items() if v}}


def json_ld(df: DataFrame, source: str = "career_page_generic") -> DataFrame:
    """schema.org postings of HTML pages: all scripts, lists, graphs and types in lists; scripts that don't parse are passed over."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for url, page in zip(b["source_url"], b["payload"]):
                for script in _SCRIPT.findall(page or ""):
                    try:
                        found = list(_walk(json.loads(script)))
                    except (ValueError, RecursionError):
                        continue
                    for node in found:
                        p = posting_of(node)
                        rows.append({"source_name": source, "source_url": url, **p, "apply_url": p["apply_url"] or url})
            yield pd.DataFrame(rows, columns=RAW_COLUMNS)

    return df.select("source_url", "payload").mapInPandas(parse, RAW)


def flat_postings(df: DataFrame, source: str = "google_jobs") -> DataFrame:
    """Postings of result pages: their JSON-LD, and for pages without any the flat objects anywhere in them that name the type."""
    kind = "`@type`: string, title: string, description: string, datePosted: string, validThrough: string, url: string, hiringOrganization: string, jobLocation: string"
    held = json_ld(df, source)
    rest = df.where(~F.coalesce("payload", F.lit("")).rlike(r"(?i)<script[^>]*application/ld\+json"))
    found = F.regexp_extract_all("payload", F.lit(r"\{[^{}]*JobPosting[^{}]*\}"), F.lit(0))
    j = rest.select("source_url", F.explode(F.transform(found, lambda o: F.from_json(o, f"struct<{kind}>"))).alias("j")).where("j.`@type` = 'JobPosting'")
    extra = {"valid_through": F.col("j.validThrough")}
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    flat = _raw(j, source, extra, title=text("j.title"), company=text("j.hiringOrganization"), location=text("j.jobLocation"), description=text("j.description"), posted_date=text("j.datePosted"), apply_url=F.coalesce(F.nullif("j.url", F.lit("")), "source_url"))
    return held.unionByName(flat)


# Sites that relative links of a portal's cards belong to.
PORTALS = {
    "linkedin": "https://www.linkedin.com", "indeed": "https://in.indeed.com", "glassdoor": "https://www.glassdoor.co.in", "naukri": "https://www.naukri.com",
    "hirist": "https://www.hirist.tech", "internshala": "https://internshala.com", "wellfound": "https://wellfound.com",
}


def portal_cards(df: DataFrame, source: str, default_place: str = "", top_n: int | None = None) -> DataFrame:
    """Landed cards of a portal as RAW rows.

    df: title, company, location, href, and where the portal shows them posted, body, experience, salary or stipend, of
    each card, in the order of ``place`` on a page ``source_url``. Cards without title or link are left out; a relative link
    gets the portal's site; an age that stands only in the card's text is taken from there. top_n: so many of each page.
    """
    has = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) if c in df.columns else F.lit("")
    link = F.when(has("href").startswith("http") | (has("href") == ""), has("href")).otherwise(F.concat(F.lit(PORTALS.get(source, "")), has("href")))
    rows = df.withColumns({"__title": has("title"), "__link": link}).where("__title <> '' and __link <> ''")
    if top_n is not None:
        from millrace.operators.matching import first_of_each

        rows = first_of_each(rows, "source_url", ["place"], top_n)
    extra = {"salary": F.coalesce(F.nullif(has("salary"), F.lit("")), has("stipend")), "experience_needed": has("experience")}
    posted = F.when(has("posted") != "", has("posted")).otherwise(age_phrase(has("body")))
    return _raw(rows, source, extra, title=F.col("__title"), company=has("company"), location=F.when(has("location") != "", has("location")).otherwise(F.lit(default_place)), description=F.lit(""), posted_date=posted, apply_url=F.col("__link"), source_url=F.col("__link"))


def listing_slug(keywords: list[str], roles: list[str]) -> str:
    """The part of a listing's address that names what is looked for: the first keyword, else the first role."""
    word = re.sub(r"[^a-z0-9]+", "-", keywords[0].lower()).strip("-") if keywords else ""
    return word or "-".join(roles[0].lower().split() if roles else ["internship"])


# Links to postings, texts that only navigate, and what a line with a place may hold.
POSTING_LINK = r"(?i)/(job|jobs|position|positions|requisition|opening|vacancy)/"
NAVIGATION = (
    "all jobs", "search jobs", "view all", "job alerts", "careers home", "job search", "find jobs", "browse jobs", "how to apply", "recommended jobs", "saved jobs",
    "login", "register", "sign in", "sign up", "contact", "about us", "faq", "learn more", "know more", "read more", "view details", "latest vacancies", "access zoho home", "apply now",
)
PLACE_LINE = r"(?i)india|bangalore|bengaluru|hyderabad|pune|mumbai|chennai|delhi|gurgaon|gurugram|noida|kolkata|remote|united states|united kingdom|singapore|germany|japan"
ANCHORS = 50


def anchor_cards(df: DataFrame, source: str = "career_page_browser") -> DataFrame:
    """Postings from the links of a rendered page: href and text of each link (columns company and place: employer and order on the page).

    The first line is the title: eight characters at least, none of the navigation's texts; the place is the first later line of 60
    characters at most with a comma or a known name. A link counts once for each page, and a page for its first ANCHORS links.
    """
    from millrace.operators.matching import first_of_each

    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), r"\r\n|\n|\r"), F.trim), lambda x: x != "")
    rows = df.where(F.col("href").rlike(POSTING_LINK)).select("*", F.explode(F.array(lines)).alias("__lines")).withColumn("__title", F.get("__lines", F.lit(0)))
    noise = F.lit(False)
    for n in NAVIGATION:
        noise = noise | F.lower("__title").contains(n)
    rows = rows.where((F.length("__title") >= 8) & ~noise)
    first = rows.groupBy("source_url", "href").agg(F.min_by(F.struct(*rows.columns), "place").alias("r")).select("r.*")
    rows = first_of_each(first, "source_url", ["place"], ANCHORS)
    later = F.filter(F.slice("__lines", 2, 1_000_000), lambda x: (F.length(x) <= 60) & (x.contains(",") | x.rlike(PLACE_LINE)))
    return _raw(rows, source, None, title=F.col("__title"), company=F.coalesce("company", F.lit("")), location=F.coalesce(F.get(later, F.lit(0)), F.lit("")), description=F.lit(""), apply_url=F.col("href"), source_url=F.col("href"))


def report_archive(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the report.json files in an archive's folders, with run_ts, the folder's name; files that don't parse give none."""
    rows = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(f"{path}/*/report.json")
    rows = rows.withColumn("run_ts", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
    if "_corrupt" in rows.columns:
        rows = rows.cache().where("_corrupt is null").drop("_corrupt")
    return rows


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Labelled pairs, one JSON object a line: structs a and b, label, notes; blank lines are passed over."""
    side = "struct<title: string, company: string, location: string, description: string, apply_url_direct: string>"
    return spark.read.schema(f"a {side}, b {side}, label int, notes string").json(path).where("label is not null")


def write_pairs(pairs: DataFrame, path: str) -> None:
    pairs.write.mode("overwrite").json(path)


def filled(cards: DataFrame, details: DataFrame, overwrite: bool = False) -> DataFrame:
    """Cards with the description of their landed detail page (apply_url, description): where blank, or everywhere."""
    found = details.groupBy("apply_url").agg(F.max("description").alias("detail"))
    own = F.nullif(F.trim(F.coalesce("description", F.lit(""))), F.lit(""))
    order = ("detail", own) if overwrite else (own, "detail")
    return cards.join(found, "apply_url", "left").withColumn("description", F.coalesce(*order)).select(*RAW_COLUMNS)


# What marks a page as an obstacle, and how far into it is looked.
BLOCK_MARKERS = ("captcha", "are you a robot", "access denied", "unusual traffic", "verify you are human")
BLOCK_WINDOW = 2000


def is_blocked(status: Column, body: Column) -> Column:
    """Whether a fetch met an obstacle instead of content."""
    head = F.lower(F.substring(F.coalesce(body, F.lit("")), 1, BLOCK_WINDOW))
    return F.coalesce(status.isin(403, 429), F.lit(False)) | head.rlike("|".join(BLOCK_MARKERS))


def outcome(status: Column, body: Column, rows: Column) -> Column:
    """What became of a fetch, from status code, body and number of rows."""
    return (
        F.when((status == 429) | F.lower(F.coalesce(body, F.lit(""))).contains("rate limit"), "rate_limited")
        .when(status == 401, "auth_required").when(status >= 500, "source_down").when(is_blocked(status, body), "blocked")
        .when(rows.isNull(), "parse_failure").when(rows == 0, "empty").otherwise("ok")
    )


@dataclass(frozen=True)
class Source:
    """A kind of feed: its name and the projection of its landed payloads."""

    name: str
    read: Callable[[DataFrame], DataFrame]


SOURCES = [
    Source("remoteok", slug_json), Source("adzuna", search_json), Source("usajobs", government_json), Source("greenhouse", board_json), Source("lever", posting_json),
    Source("linkedin_guest", html_cards), Source("career_page_generic", json_ld), Source("career_page_browser", anchor_cards), Source("google_jobs", flat_postings),
    *[Source(name, functools.partial(portal_cards, source=name)) for name in PORTALS],
]
#: Feeds that are read from files, not from landed payloads: name to whether the company leads the title.
RSS_SOURCES = {"weworkremotely": True, "remotive": False, "jobicy": False}


def union(payloads: dict[str, DataFrame], rss: dict[str, tuple[SparkSession, str]] | None = None) -> DataFrame | None:
    """Rows of all payloads and RSS files (name to session and path), by the name of their source; None for none."""
    parts = [s.read(payloads[s.name]) for s in SOURCES if s.name in payloads]
    parts += [rss_items(session, path, name, RSS_SOURCES[name]) for name, (session, path) in (rss or {}).items()]
    return functools.reduce(DataFrame.unionByName, parts) if parts else None

"""Queries of the core operators over the posting tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from millrace.functions import similarity, text as X, urls as U
from millrace.operators import blocking, evaluation as E, packed, state
from millrace.session import is_blank, table, utrim

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# ---- SQL pieces -------------------------------------------------------------------------------------------------
WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def _key(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower({_trim(f'coalesce({x}, chr(32))')}), '{WS}+', ' ', 'g'), '[^a-z0-9 ]+', '', 'g')"


def _norm(x: str) -> str:
    return f"trim({_key(x)})"


def _tok(x: str) -> str:
    return f"list_filter(string_split_regex({x}, ' +'), lambda t: t <> '')"


def _words_only(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', ' ', 'g'))"


def _company(x: str) -> str:
    return f"trim(regexp_replace({_words_only(x)}, '(?:(?:^| )(?:{'|'.join(X.COMPANY_SUFFIXES)}))+$', ''))"


def _loc(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '\\b(?:{'|'.join(X.REMOTE_WORDS)})\\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"


def _bucket(x: str) -> str:
    return f"case when {_loc(x)} <> '' then {_loc(x)} when regexp_matches(lower(coalesce({x}, '')), '{'|'.join(X.REMOTE_WORDS)}') then 'remote' else '' end"


def _stem(x: str) -> str:
    levels = ", ".join(f"'{w}'" for w in X.LEVEL_WORDS)
    return f"array_to_string(list_filter({_tok(_norm(x))}, lambda t: t not in ({levels}))[1:2], ' ')"


def _authority(x: str) -> str:
    return f"lower(regexp_extract(coalesce({x}, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"


def _domain(x: str) -> str:
    return f"regexp_replace(regexp_replace({_authority(x)}, '^.*@', ''), '^www\\.', '')"


def _ndomain(x: str) -> str:
    d = f"regexp_replace(regexp_replace(regexp_replace(lower({_trim(f'coalesce({x}, chr(32))')}), '/+$', ''), '^www\\.', ''), '^.*@', '')"
    return f"case when {d} like '%://%' then coalesce(nullif({_authority(d)}, ''), {d}) else {d} end"


def _shingles(x: str) -> str:
    t = _tok(_norm(x))
    return f"list_distinct(case when len({t}) = 0 then [] when len({t}) < 3 then [array_to_string({t}, ' ')] else list_transform(range(1, len({t}) - 1), lambda i: array_to_string(({t})[i:i+2], ' ')) end)"


def _jaccard(a: str, b: str) -> str:
    return f"case when len({a}) = 0 and len({b}) = 0 then 1.0 else len(list_intersect({a}, {b}))::double / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) end"


def _jw(a: str, b: str) -> str:
    """Jaro with a bonus for equal first letters, of two lower-cased texts."""
    head = f"case when {a}[1:1] <> {b}[1:1] then 0 when {a}[2:2] <> {b}[2:2] or least(length({a}), length({b})) < 2 then 1 when {a}[3:3] <> {b}[3:3] or least(length({a}), length({b})) < 3 then 2 when {a}[4:4] <> {b}[4:4] or least(length({a}), length({b})) < 4 then 3 else 4 end"
    return f"case when {a} = {b} then 1.0 when {a} = '' or {b} = '' then 0.0 else jaro_similarity({a}, {b}) + ({head}) * 0.1 * (1 - jaro_similarity({a}, {b})) end"


def _blank(x: str) -> str:
    return f"({x} is null or upper({_trim(x)}) in ('', 'MISSING'))"


def query(sql: str | None = None):
    """Register a function as the query of its name, with its SQL."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# ---- scalars ----------------------------------------------------------------------------------------------------
@query(f"select raw_id, {_key('title')} as title_key, {_norm('title')} as title_norm, {_norm('location')} as location_norm from raw_jobs")
def text_normalize(spark, d):
    return table(spark, d, "raw_jobs").select("raw_id", X.key_text(F.col("title")).alias("title_key"), X.normalize_text(F.col("title")).alias("title_norm"), X.normalize_text(F.col("location")).alias("location_norm"))


@query(f"select raw_id, sha1({_key('title')} || '|' || {_key('company')} || '|' || {_key('location')}) as job_hash from raw_jobs")
def job_hash(spark, d):
    return table(spark, d, "raw_jobs").select("raw_id", X.identity_hash(F.col("title"), F.col("company"), F.col("location")).alias("job_hash"))


_S = _trim("coalesce(apply_url_direct, '')")
_KEPT = f"array_to_string(list_filter(string_split(regexp_extract({_S}, '^[^?#]*\\?([^#]*)', 1), '&'), lambda kv: kv <> '' and not regexp_matches(lower(regexp_extract(kv, '^([^=]*)', 1)), '^(?:utm_.*|{'|'.join(U.TRACKING)})$')), '&')"


@query(
    f"""select job_row_id, case when {_S} = '' then '' else coalesce(nullif(lower(regexp_extract({_S}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)), ''), 'https') || '://'
        || regexp_replace(regexp_replace({_authority(_S)}, '^www\\.', ''), ':(?:80|443)$', '') || regexp_replace(regexp_extract({_S}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), '/+$', '')
        || case when {_KEPT} <> '' then '?' || {_KEPT} else '' end end as canonical_url, {_domain('apply_url_direct')} as domain from jobs"""
)
def url_canonical(spark, d):
    return table(spark, d, "jobs").select("job_row_id", U.canonical_url(F.col("apply_url_direct")).alias("canonical_url"), U.url_domain(F.col("apply_url_direct")).alias("domain"))


@query(
    f"""select company, {_company('company')} as entity, replace(regexp_replace({_words_only('company')}, ' +(?:{'|'.join(X.HINT_SUFFIXES)})$', ''), ' ', '') as domain_hint, count(*) as n from jobs group by company"""
)
def company_normalize(spark, d):
    c = F.col("company")
    return table(spark, d, "jobs").groupBy("company").agg(F.count("*").alias("n")).select("company", X.company_entity(c).alias("entity"), X.company_domain_hint(c).alias("domain_hint"), "n")


@query(f"select bucket, count(*) as n, count(distinct location) as spellings from (select location, {_bucket('location')} as bucket from raw_jobs) group by bucket")
def location_buckets(spark, d):
    return table(spark, d, "raw_jobs").select("location", X.location_bucket(F.col("location")).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"), F.count_distinct("location").alias("spellings"))


@query(f"select stem, count(*) as n from (select {_stem('title')} as stem from raw_jobs) group by stem")
def title_stems(spark, d):
    return table(spark, d, "raw_jobs").select(X.title_stem(F.col("title")).alias("stem")).groupBy("stem").agg(F.count("*").alias("n"))


def _keys_sql(tab: str) -> str:
    dom = _ndomain(f"coalesce(nullif(employer_domain, ''), {_domain('apply_url_direct')})")
    return f"""select job_row_id, unnest([case when c <> '' and s <> '' then c || '|' || s end, case when c <> '' and b <> '' then c || '|' || b end, case when m <> '' and s <> '' then m || '|' || s end,
        case when p <> '' then p end, case when m <> '' and s <> '' then 'apply:' || m || '|' || s end]) as block_key from (select job_row_id, {_company('company')} as c, {_stem('title')} as s, {_bucket('location')} as b, {dom} as m, {_trim("coalesce(posting_id, '')")} as p from {tab})"""


@query(f"select * from ({_keys_sql('jobs')}) where block_key is not null")
def block_keys(spark, d):
    jobs = table(spark, d, "jobs")
    return jobs.select("job_row_id", F.explode(blocking.blocking_keys(jobs)).alias("block_key"))


@query("select raw_id, regexp_extract(coalesce(apply_url, ''), '/(\\d{8,})(?:/|\\?|$)', 1) as posting_id from raw_jobs")
def posting_ids(spark, d):
    return table(spark, d, "raw_jobs").select("raw_id", U.posting_id(F.col("source_name"), F.col("apply_url")).alias("posting_id"))


@query(f"select job_row_id, len(s) as n_shingles, case when len(s) > 0 then sha1(array_to_string(list_sort(s), '|')) else '' end as fingerprint from (select job_row_id, {_shingles('description')} as s from jobs)")
def description_fingerprints(spark, d):
    # behind a generator the shingles are made once for both uses
    rows = table(spark, d, "jobs").select("job_row_id", F.explode(F.array(X.shingles(F.col("description")))).alias("s"))
    return rows.select("job_row_id", F.size("s").alias("n_shingles"), X.fingerprint(F.col("s")).alias("fingerprint"))


@query(f"select text_key, count(*) as n, min(doc_id) as first_id, max(doc_id) as last_id from (select doc_id, sha1({_norm('text')}) as text_key from documents where text is not null) group by text_key having count(*) > 1")
def exact_copies(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.sha1(X.normalize_text(F.col("text"))).alias("text_key"))
    return docs.groupBy("text_key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("n > 1")


_ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")]
_H = "regexp_replace(regexp_replace(coalesce(text, ''), '(?is)<script\\b.*?</script>|<style\\b.*?</style>', ' ', 'g'), '(?s)<[a-zA-Z/!][^>]*>', ' ', 'g')"
for _a, _b in _ENTITIES:
    _H = f"replace({_H}, '{_a}', '{_b}')"


@query(f"select doc_id, md5({_trim(f"regexp_replace({_H}, '{WS}+', ' ', 'g')")}) as text_md5 from documents where contains(text, '<') or contains(text, '&')")
def html_texts(spark, d):
    docs = table(spark, d, "documents").where(F.col("text").contains("<") | F.col("text").contains("&"))
    return docs.select("doc_id", F.md5(X.html_text(F.col("text"))).alias("text_md5"))


@query(f"select doc_id, md5({_trim(f"regexp_replace({_H}, '{WS}+', ' ', 'g')")}) as text_md5 from documents")
def document_texts(spark, d):
    """As html_texts, of every document; a null text counts as empty."""
    return table(spark, d, "documents").select("doc_id", F.md5(X.html_text(F.col("text"))).alias("text_md5"))


def _years() -> str:
    low = "lower(coalesce(description, ''))"
    cases = " ".join(f"when contains({low}, '{n}+ year') or contains({low}, '{n} {w}') then '{n}+ {w}'" for n, w in ((5, "years"), (3, "years"), (2, "years"), (1, "year")))
    return f"case {cases} else '' end"


@query(f"select experience, count(*) as n from (select {_years()} as experience from raw_jobs) group by experience")
def experience_tiers(spark, d):
    return table(spark, d, "raw_jobs").select(X.experience(F.col("description")).alias("experience")).groupBy("experience").agg(F.count("*").alias("n"))


@query(
    """select skill, count(*) as n from (select trim(regexp_replace(regexp_replace(lower(unnest(from_json(extra['tags'], '["VARCHAR"]'))), '\\s+', ' ', 'g'), '[^a-z0-9 ]+', '', 'g')) as skill from raw_jobs where extra['tags'] is not null) group by skill"""
)
def tag_skills(spark, d):
    tags = table(spark, d, "raw_jobs").select(F.explode(F.from_json(F.try_element_at("extra", F.lit("tags")), "array<string>")).alias("tag"))
    return tags.select(X.skill(F.col("tag")).alias("skill")).groupBy("skill").agg(F.count("*").alias("n"))


# ---- relevance --------------------------------------------------------------------------------------------------
TERMS = ["data", "engineer", "logistics", "audits", "remote"]


@query(
    f"""select doc_id, s / 5.0 as coverage from (select doc_id, {' + '.join(f"(len(list_filter(t, lambda x: x = '{w}')) * 2.5 / (len(list_filter(t, lambda x: x = '{w}')) + 1.5))" for w in TERMS)} as s
        from (select doc_id, {_tok(_norm('text'))} as t from documents)) where s > 0"""
)
def bm25_coverage(spark, d):
    """BM25 of five terms with the length of a document as the mean length, as a share of the terms."""
    t = table(spark, d, "documents").select("doc_id", F.explode(F.array(X.tokens(X.normalize_text(F.col("text"))))).alias("t"))

    def part(w: str) -> Column:
        n = F.size(F.filter("t", lambda x: x == w))
        return n * 2.5 / (n + 1.5)

    return t.select("doc_id", (sum((part(w) for w in TERMS), F.lit(0.0)) / len(TERMS)).alias("coverage")).where("coverage > 0")


@query(
    f"""with t as (select distinct doc_id, unnest({_tok(_norm('text'))}) as term from documents), n as (select count(*) as n from documents)
        select term, count(*) as df, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) as idf from t, n group by term"""
)
def bm25_idf(spark, d):
    docs = table(spark, d, "documents")
    n = docs.count()
    terms = docs.select(F.explode(F.array_distinct(X.tokens(X.normalize_text(F.col("text"))))).alias("term"))
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    return df.withColumn("idf", F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)))


@query("select raw_id, regexp_matches(lower(coalesce(title, '')), '\\b(?:engineer|data scientist|analyst)\\b') as wanted, regexp_matches(lower(coalesce(title, '') || ' ' || coalesce(description, '')), '\\b(?:night shift|on-site)\\b') as excluded from raw_jobs")
def term_filters(spark, d):
    title, desc = F.coalesce("title", F.lit("")), F.coalesce("description", F.lit(""))
    return table(spark, d, "raw_jobs").select("raw_id", X.any_term(title, ["engineer", "data scientist", "analyst"]).alias("wanted"), X.any_term(F.concat_ws(" ", title, desc), ["night shift", "on-site"]).alias("excluded"))


# ---- pairs ------------------------------------------------------------------------------------------------------
FIELDS = ["title", "company", "location", "description", "employer_domain", "apply_url_direct"]


def _hash_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Incoming rows with the stored rows of their posting id, each with the terms of its score, worked out before the join: no description travels."""
    sides = [blocking.terms(table(spark, d, t).where("posting_id is not null").select("posting_id", F.col("job_row_id").alias(f"id{i}"), *FIELDS), i) for i, t in ((1, "incoming_jobs"), (2, "jobs"))]
    return sides[0].join(sides[1], "posting_id").drop("posting_id")


def _pairs_sql() -> str:
    cols = ", ".join(f"a.{c} as {c}1, b.{c} as {c}2" for c in FIELDS)
    base = f"select a.job_row_id as id1, b.job_row_id as id2, {cols} from incoming_jobs a join jobs b on a.posting_id = b.posting_id"
    terms = ", ".join(
        f"lower(coalesce(title{i}, '')) as t{i}, {_company(f'company{i}')} as n{i}, coalesce(nullif({_ndomain(f'employer_domain{i}')}, ''), {_ndomain(_domain(f'apply_url_direct{i}'))}) as d{i}, {_ndomain(_domain(f'apply_url_direct{i}'))} as u{i}, list_distinct({_tok(_loc(f'location{i}'))}) as l{i}, {_shingles(f'description{i}')} as s{i}"
        for i in (1, 2)
    )
    loc = f"case when coalesce(location1, '') = '' and coalesce(location2, '') = '' then 1.0 when coalesce(location1, '') = '' or coalesce(location2, '') = '' then 0.5 when lower({_trim('location1')}) = lower({_trim('location2')}) then 1.0 else {_jaccard('l1', 'l2')} end"
    desc = f"case when coalesce(description1, '') = '' or coalesce(description2, '') = '' then 0.5 else {_jaccard('s1', 's2')} end"
    same = lambda a, b: f"case when {a} = '' or {b} = '' then 0.5 when {a} = {b} then 1.0 else 0.0 end"
    name = "case when n1 <> '' and n2 <> '' then jc when n1 = '' and n2 = '' then 1.0 else 0.5 end"
    return f"""with p as ({base}), q as (select *, {terms} from p), r as (select *, {_jw('t1', 't2')} as jt, {_jw('n1', 'n2')} as jc from q),
        s as (select *, 0.45 * ({name}) + 0.35 * ({same('d1', 'd2')}) + 0.20 * ({same('u1', 'u2')}) as c0 from r),
        t as (select *, case when n1 <> '' and n2 <> '' and jc >= 0.90 and d1 <> '' and d2 <> '' then case when d1 = d2 then greatest(c0, 0.95) else least(c0, 0.55) end else c0 end as cc from s),
        v as (select *, 0.35 * jt + 0.25 * cc + 0.15 * ({loc}) + 0.25 * ({desc}) as score from t)
        select id1, id2, round(jt, 6) as title_similarity, round(cc, 6) as company_similarity, round(score, 6) as score, case when jt < 0.75 then 'none' when score >= 0.88 and cc >= 0.60 and not (d1 <> '' and d2 <> '' and d1 <> d2 and n1 <> '' and n2 <> '' and jc >= 0.60) then 'auto_merge' when score >= 0.80 then 'review' else 'none' end as verdict from v"""


@query(_pairs_sql())
def composite_pairs(spark, d):
    s = blocking.scored_terms(_hash_pairs(spark, d))
    return s.select("id1", "id2", F.round("jw_title", 6).alias("title_similarity"), F.round("c_company", 6).alias("company_similarity"), F.round("score", 6).alias("score"), "verdict")


@query(f"select id1, arg_max(id2, (score, -id2)) as best_id, max(score) as score, arg_max(verdict, (score, -id2)) as verdict from ({_pairs_sql()}) group by id1")
def best_candidates(spark, d):
    """The candidate with the highest score of each incoming row, whatever its verdict; of equal ones that with the smaller id."""
    s = composite_pairs(spark, d)
    top = F.max(F.struct("score", (-F.col("id2")).alias("m"), "verdict"))
    return s.groupBy("id1").agg(top.alias("t")).select("id1", (-F.col("t.m")).alias("best_id"), "t.score", "t.verdict")


def _tier_keys() -> list[Column]:
    return [F.array(F.lower("job_id_hash")), F.array("posting_id")]


@query(
    """select id1, id2, min(tier) as tier from (select a.job_row_id as id1, b.job_row_id as id2, 0 as tier from incoming_jobs a join jobs b on lower(a.job_id_hash) = lower(b.job_id_hash) where a.job_id_hash <> ''
        union all select a.job_row_id, b.job_row_id, 1 from incoming_jobs a join jobs b on a.posting_id = b.posting_id where a.posting_id <> '') group by id1, id2"""
)
def candidate_tiers(spark, d):
    left = table(spark, d, "incoming_jobs").withColumnRenamed("job_row_id", "id1")
    right = table(spark, d, "jobs").withColumnRenamed("job_row_id", "id2")
    return blocking.candidates(left, right, "id1", "id2", _tier_keys())


def _known(c: Column) -> Column:
    """The trimmed text; null where it is blank."""
    return F.when(~is_blank(c), utrim(c))


def canonical_id(posting: Column, url: Column, hashed: Column) -> Column:
    """Posting id, else canonical URL, else company and title, else these and the place, else the hash."""
    title, company = F.col("title"), F.col("company")
    entity = X.normalize_company(company)
    by_name = F.when((entity != "") & (F.coalesce(title, F.lit("")) != ""), F.concat(entity, F.lit("|"), X.key_text(title)))
    by_place = F.when((company != "") & (title != "") & (F.col("location") != ""), F.concat_ws("|", *[X.key_text(F.col(c)) for c in ("company", "title", "location")]))
    parts = (("posting:", posting), ("url:", url), ("ct:", by_name), ("ct:", by_place), ("hash:", F.coalesce(hashed, X.identity_hash(title, company, F.col("location")))))
    return F.coalesce(*[F.concat(F.lit(p), c) for p, c in parts])


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Incoming and stored rows (id1, id2) with what they are looked up by; stored ones as stored, incoming ones worked out."""
    new, held = (packed.with_values(table(spark, d, t), "block_key", packed.KEYS, "_keys") for t in ("incoming_jobs", "jobs"))
    new = new.withColumns({"_hash": F.lower(_known(F.col("job_id_hash"))), "_url": F.when(~is_blank(F.col("apply_url_direct")), U.canonical_url(F.col("apply_url_direct"))), "_posting": _known(F.col("posting_id"))})
    new = new.withColumn("_id", F.lower(utrim(canonical_id(F.col("_posting"), F.col("_url"), F.col("_hash"))))).withColumn("_keys", F.when(F.size("_keys") > 0, F.col("_keys")).otherwise(blocking.blocking_keys(new)))
    held = held.withColumns({"_hash": F.lower(_known(F.col("job_id_hash"))), "_url": _known(F.col("canonical_url")), "_posting": _known(F.col("posting_id")), "_id": F.lower(_known(F.col("canonical_job_id")))})
    lookup = ["_hash", "_id", "_url", "_posting", "_keys"]
    return new.select(F.col("job_row_id").alias("id1"), *lookup), held.select(F.col("job_row_id").alias("id2"), *lookup)


def _all_tiers() -> list[Column]:
    """Hash, canonical id, canonical URL or posting id, block keys."""
    return [F.array("_hash"), F.array("_id"), F.array(F.concat(F.lit("url:"), F.col("_url")), F.concat(F.lit("posting:"), F.col("_posting"))), F.col("_keys")]


# no SQL for the block_ queries: block keys stand in packed lists; tests hold them against brute force
@query()
def block_candidates(spark, d):
    """Each pair of an incoming and a stored row that meets in a tier, with the first such tier; no bound on their number."""
    left, right = _sides(spark, d)
    return blocking.candidates(left, right, "id1", "id2", _all_tiers())


@query()
def block_pairs(spark, d):
    """The pairs of block_candidates with their scores; an equal hash scores 1 and is merged, whatever the texts."""
    fields = tuple(table(spark, d, t).select(F.col("job_row_id").alias(i), *FIELDS) for t, i in (("incoming_jobs", "id1"), ("jobs", "id2")))
    s = blocking.scored_terms(blocking.met(*_sides(spark, d), _all_tiers(), fields, blocking.terms))
    same = F.col("tier") == 0
    score, verdict = F.when(same, 1.0).otherwise(F.round("score", 6)), F.when(same, "auto_merge").otherwise(F.col("verdict"))
    return s.select("id1", "id2", "tier", F.round("jw_title", 6).alias("title_similarity"), F.round("c_company", 6).alias("company_similarity"), score.alias("score"), verdict.alias("verdict"))


@query()
def block_best(spark, d):
    """The best of block_pairs for each incoming row, whatever its verdict: an equal hash, else the highest score; of equal ones that of the first tier, then of the smaller id."""
    top = F.max(F.struct((F.col("tier") == 0).alias("same"), "score", (-F.col("tier")).alias("t"), (-F.col("id2")).alias("m"), "verdict"))
    return block_pairs(spark, d).groupBy("id1").agg(top.alias("t")).select("id1", (-F.col("t.m")).alias("best_id"), (-F.col("t.t")).alias("tier"), "t.score", "t.verdict")


# ---- aggregation, windows, sets ---------------------------------------------------------------------------------
@query("select r.source_name, coalesce(f.authority, 1) as authority, count(*) as n from raw_jobs r left join feed_sources f on r.source_name = f.source_name group by all")
def authority_join(spark, d):
    feeds = table(spark, d, "feed_sources").select("source_name", "authority")
    counts = table(spark, d, "raw_jobs").groupBy("source_name").agg(F.count("*").alias("n"))
    return counts.join(feeds, "source_name", "left").select("source_name", F.coalesce("authority", F.lit(1)).alias("authority"), "n")


@query("select raw_id from (select raw_id, row_number() over (partition by lower(coalesce(title, '')), lower(coalesce(company, '')) order by run_no, raw_id) as k from raw_jobs) where k = 1")
def first_arrivals(spark, d):
    """The first row for each title and company: an aggregation, so hot keys meet as partial minima."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    return table(spark, d, "raw_jobs").groupBy(low("title"), low("company")).agg(F.min_by("raw_id", F.struct("run_no", "raw_id")).alias("raw_id")).select("raw_id")


@query("select origin, source_name, count(*) as n from (select 'raw' as origin, source_name from raw_jobs union all select 'stored', source_name from jobs union all select 'incoming', source_name from incoming_jobs) group by all")
def union_sources(spark, d):
    parts = [table(spark, d, t).select(F.lit(n).alias("origin"), "source_name") for n, t in (("raw", "raw_jobs"), ("stored", "jobs"), ("incoming", "incoming_jobs"))]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).groupBy("origin", "source_name").agg(F.count("*").alias("n"))


@query("select coalesce(authentic_status, 'UNKNOWN') as status, coalesce(nullif(decision, ''), 'NONE') as decision, count(*) as n, count(*) filter (authentic_status = 'CLOSED') as closed, round(avg(match_score), 6) as avg_match, min(first_seen_at) as first_seen, max(first_seen_at) as last_first_seen from jobs group by all")
def dashboard_stats(spark, d):
    g = table(spark, d, "jobs").groupBy(F.coalesce("authentic_status", F.lit("UNKNOWN")).alias("status"), F.coalesce(F.nullif("decision", F.lit("")), F.lit("NONE")).alias("decision"))
    return g.agg(F.count("*").alias("n"), F.count_if(F.col("authentic_status") == "CLOSED").alias("closed"), F.round(F.avg("match_score"), 6).alias("avg_match"), F.min("first_seen_at").alias("first_seen"), F.max("first_seen_at").alias("last_first_seen"))


@query(f"select key, raw_id, run_no from (select {_key('title')} || '|' || {_key('company')} as key, raw_id, run_no, row_number() over (partition by {_key('title')} || '|' || {_key('company')} order by run_no desc, raw_id desc) as k from raw_jobs) where k = 1")
def latest_wins(spark, d):
    key = F.concat_ws("|", X.key_text(F.col("title")), X.key_text(F.col("company")))
    return state.latest(table(spark, d, "raw_jobs"), key, ["run_no", "raw_id"], ["raw_id", "run_no"])


@query("select run_no, count(*) as n, count(distinct source_name) as n_sources from raw_jobs group by run_no")
def run_counts(spark, d):
    return table(spark, d, "raw_jobs").groupBy("run_no").agg(F.count("*").alias("n"), F.count_distinct("source_name").alias("n_sources"))


@query("select run_no, source_name, status, row_count from (select *, row_number() over (partition by run_no, source_name order by started_at desc, row_count desc, coalesce(status, '') desc) as k from source_outcomes) where k = 1")
def source_statuses(spark, d):
    """The last outcome logged for each run and source."""
    o = table(spark, d, "source_outcomes")
    top = F.max(F.struct("started_at", "row_count", F.coalesce("status", F.lit("")).alias("s"), "status"))
    return o.groupBy("run_no", "source_name").agg(top.alias("t")).select("run_no", "source_name", "t.status", "t.row_count")


@query("select distinct run_no, source_name from source_outcomes o where status = 'ok' and not exists (select 1 from raw_jobs r where r.run_no = o.run_no and r.source_name = o.source_name)")
def no_match_sources(spark, d):
    ok = table(spark, d, "source_outcomes").where("status = 'ok'").select("run_no", "source_name").distinct()
    return ok.join(table(spark, d, "raw_jobs").select("run_no", "source_name").distinct(), ["run_no", "source_name"], "left_anti")


@query("select job_row_id, row_number() over (order by case decision when 'AUTO_ACCEPT' then 3 when 'REVIEW' then 2 else 0 end desc, match_score desc, first_seen_at, job_row_id) as place from jobs qualify place <= 100")
def rank_topk(spark, d):
    """The hundred best postings: by decision, score, age and id. A top-k without a global sort."""
    rank = F.when(F.col("decision") == "AUTO_ACCEPT", 3).when(F.col("decision") == "REVIEW", 2).otherwise(0)
    order = [rank.desc(), F.desc_nulls_last("match_score"), F.asc("first_seen_at"), F.asc("job_row_id")]
    best = table(spark, d, "jobs").orderBy(*order).limit(100)
    return best.select("job_row_id", F.row_number().over(Window.orderBy(*order)).alias("place"))


@query("select lower(trim(job_id_hash)) as job_hash, count(*) as n, count(distinct source_name) as n_sources, min(first_seen_at) as first_seen from jobs where job_id_hash is not null group by 1")
def seen_counts(spark, d):
    jobs = table(spark, d, "jobs").where("job_id_hash is not null")
    return jobs.groupBy(F.lower(F.trim("job_id_hash")).alias("job_hash")).agg(F.count("*").alias("n"), F.count_distinct("source_name").alias("n_sources"), F.min("first_seen_at").alias("first_seen"))


@query(
    """with old as (select lower(job_id_hash) as h, min(first_seen_at) as f, max(first_seen_at) as l, list_distinct(list(source_name) filter (source_name <> '')) as names, arg_max(authentic_status, (first_seen_at, authentic_status)) as st from jobs where job_id_hash is not null group by 1),
        new as (select lower(job_id_hash) as h, min(epoch_us(arrived_at)) / 1e6 as f, max(epoch_us(arrived_at)) / 1e6 as l, list_distinct(list(source_name) filter (source_name <> '')) as names from incoming_jobs where job_id_hash is not null group by 1)
        select coalesce(o.h, n.h) as job_id_hash, coalesce(o.f, n.f) as first_seen, coalesce(n.l, o.l) as last_seen, len(list_distinct(list_concat(coalesce(o.names, []), coalesce(n.names, [])))) as n_sources, o.h is null as is_new from old o full join new n on o.h = n.h"""
)
def upsert_state(spark, d):
    jobs = table(spark, d, "jobs").where("job_id_hash is not null").withColumn("job_id_hash", F.lower("job_id_hash"))
    held = jobs.groupBy("job_id_hash").agg(F.min("first_seen_at").alias("first_seen"), F.max("first_seen_at").alias("last_seen"), state.sources_in_order("first_seen_at", "source_name").alias("source_names"), F.max_by("authentic_status", F.struct("first_seen_at", "authentic_status")).alias("authentic_status"))
    batch = table(spark, d, "incoming_jobs").where("job_id_hash is not null").select(F.lower("job_id_hash").alias("job_id_hash"), (F.unix_micros("arrived_at") / 1e6).alias("seen"), "source_name", F.lit("AUTHENTIC").alias("authentic_status"))
    return state.upsert(held, batch).select("job_id_hash", "first_seen", "last_seen", F.size("source_names").alias("n_sources"), "is_new")


@query("select job_row_id from jobs where not (coalesce(authentic_status, '') = 'CLOSED' and coalesce((case when last_seen_at >= 1e11 then last_seen_at / 1000 else last_seen_at end) < 1750000000 - 90 * 86400, false))")
def prune_closed(spark, d):
    seen = F.when(F.col("last_seen_at") >= 1e11, F.col("last_seen_at") / 1000).otherwise(F.col("last_seen_at"))
    return state.pruned(table(spark, d, "jobs"), seen, 1750000000).select("job_row_id")


@query(f"select raw_id, array_to_string(list_filter([case when {_blank('title')} then 'title' end, case when {_blank('company')} then 'company' end, case when {_blank('apply_url')} then 'apply_url' end, case when {_blank('posted_date')} then 'posted_date' end], lambda x: x is not null), ',') as missing from raw_jobs")
def missing_fields(spark, d):
    marks = [F.when(is_blank(F.col(f)), F.lit(f)) for f in ("title", "company", "apply_url", "posted_date")]
    return table(spark, d, "raw_jobs").select("raw_id", F.array_join(F.array_compact(F.array(*marks)), ",").alias("missing"))


@query("select o_orderkey, case when a < 0 or a <= 1 then 'fresh' when a <= 7 then 'recent' when a <= 30 then 'older' else 'stale' end as freshness from (select o_orderkey, (epoch_us(timestamp '1998-08-01') - epoch_us(o_orderdate)) / 86400e6 as a from orders)")
def freshness_bands(spark, d):
    age = (F.unix_micros(F.lit("1998-08-01 00:00:00").cast("timestamp")) - F.unix_micros(F.col("o_orderdate").cast("timestamp"))) / 86400e6
    return table(spark, d, "orders").select("o_orderkey", F.when(age <= 1, "fresh").when(age <= 7, "recent").when(age <= 30, "older").otherwise("stale").alias("freshness"))


# ---- evaluation -------------------------------------------------------------------------------------------------
_LABELLED = "select case when possible_duplicate_of is null then 0 else 1 end as label, identity_score as score from jobs where identity_score is not null"


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").where("identity_score is not null").select(F.when(F.col("possible_duplicate_of").isNull(), 0).otherwise(1).alias("label"), F.col("identity_score").alias("score"))


@query(
    f"""with n as (select t::double as threshold, count(*) filter (score >= t and label = 1) as tp, count(*) filter (score >= t and label = 0) as fp, count(*) filter (score < t and label = 1) as fn from ({_LABELLED}), (select unnest([0.75, 0.8, 0.88]) as t) group by t),
        p as (select *, case when tp + fp = 0 then 0.0 else tp::double / (tp + fp) end as precision, case when tp + fn = 0 then 0.0 else tp::double / (tp + fn) end as recall from n)
        select *, case when precision + recall = 0 then 0.0 else 2 * precision * recall / (precision + recall) end as f1 from p"""
)
def prf_thresholds(spark, d):
    return E.prf(_labelled(spark, d), "label", "score", [0.75, 0.80, 0.88])


@query(f"select least(floor(score * 10), 9)::int as bin, count(*) as n, round(avg(label), 6) as accuracy, round(avg(score), 6) as confidence from ({_LABELLED}) where score between 0 and 1 group by 1")
def calibration_bins(spark, d):
    return E.calibration_bins(_labelled(spark, d), "label", "score").select("bin", "n", F.round("accuracy", 6).alias("accuracy"), F.round("confidence", 6).alias("confidence"))


@query(f"select round(sum(abs(a - c) * n) / sum(n), 6) as ece from (select count(*) as n, avg(label) as a, avg(score) as c from ({_LABELLED}) where score between 0 and 1 group by least(floor(score * 10), 9))")
def ece(spark, d):
    return E.expected_calibration_error(_labelled(spark, d), "label", "score").select(F.round("ece", 6).alias("ece"))


@query(f"select round(1 / (1 + exp(-(2.0 * score - 1.0))), 9) as p, count(*) as n from ({_LABELLED}) group by 1")
def platt_apply(spark, d):
    return _labelled(spark, d).groupBy(F.round(E.sigmoid(2.0 * F.col("score") - 1.0), 9).alias("p")).agg(F.count("*").alias("n"))


_OFF = "q.n / (1 + exp(-(a * q.x + b))) - q.n * q.y"


@query(
    f"""with recursive p as (select list({{x: x, y: y, n: n}}) as l, sum(n) as t from (select round(least(greatest(score, 0), 1), 6) as x, label::double as y, count(*)::double as n from ({_LABELLED}) group by 1, 2)),
        g(k, a, b) as (select 0, 1.0::double, 0.0::double union all select k + 1, a - 0.5 * list_sum(list_transform(l, lambda q: ({_OFF}) * q.x)) / t, b - 0.5 * list_sum(list_transform(l, lambda q: {_OFF})) / t from g, p where k < 300)
        select round(a, 6) as a, round(b, 6) as b from g where k = 300"""
)
def platt_fit(spark, d):
    a, b = E.platt_fit(_labelled(spark, d), "label", "score")
    return spark.range(1).select(F.round(F.lit(a), 6).alias("a"), F.round(F.lit(b), 6).alias("b"))


_FS = ["title", "company", "location"]


def _fs_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Labelled pairs: incoming and stored rows of one posting id; the label tells whether their hashes are equal too."""
    left = table(spark, d, "incoming_jobs").where("posting_id is not null").select("posting_id", F.col("job_row_id").alias("id1"), F.lower("job_id_hash").alias("h1"), *[F.col(c).alias(c + "1") for c in _FS])
    right = table(spark, d, "jobs").where("posting_id is not null").select("posting_id", F.col("job_row_id").alias("id2"), F.lower("job_id_hash").alias("h2"), *[F.col(c).alias(c + "2") for c in _FS])
    return left.join(right, "posting_id").withColumn("label", F.when(F.col("h1") == F.col("h2"), 1).otherwise(0))


_AGREE = ", ".join(f"({_norm(f'a.{f}')} <> '' and {_norm(f'a.{f}')} = {_norm(f'b.{f}')}) as g_{f}" for f in _FS)
_FSP = f"select a.job_row_id as id1, b.job_row_id as id2, case when lower(a.job_id_hash) = lower(b.job_id_hash) then 1 else 0 end as label, {_AGREE} from incoming_jobs a join jobs b on a.posting_id = b.posting_id"
_MU = " union all ".join(
    f"select '{f}' as field, case when count(*) filter (label = 1) > 0 then (count(*) filter (label = 1 and g_{f}) + 1.0::double) / (count(*) filter (label = 1) + 2) else 0.5 end as m, case when count(*) filter (label = 0) > 0 then (count(*) filter (label = 0 and g_{f}) + 1.0::double) / (count(*) filter (label = 0) + 2) else 0.5 end as u from p"
    for f in _FS
)


@query(f"with p as ({_FSP}) select field, round(m, 9) as m, round(u, 9) as u from ({_MU})")
def fs_estimates(spark, d):
    return E.m_u(_fs_pairs(spark, d), _FS, "label").select("field", F.round("m", 9).alias("m"), F.round("u", 9).alias("u"))


_WEIGHT = " + ".join(f"(select case when g_{f} then log2(m / u) else log2((1 - m) / (1 - u)) end from e where field = '{f}')" for f in _FS)


@query(f"with p as ({_FSP}), e as ({_MU}), w as (select id1, id2, {_WEIGHT} as weight from p) select id1, id2, round(weight, 6) as weight, case when weight >= 2 then 'HIGH' when weight >= 0 then 'MIDDLE' else 'LOW' end as class from w")
def fs_weights(spark, d):
    pairs = _fs_pairs(spark, d)
    return E.pair_weights(pairs, _FS, E.m_u(pairs, _FS, "label"), 0.0, 2.0).select("id1", "id2", F.round("weight", 6).alias("weight"), "class")

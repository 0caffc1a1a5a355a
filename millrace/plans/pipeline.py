"""Queries of projection, profile filter, relevance, evidence, dates, candidates and cross-run views, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from millrace.functions import dates as D, text as X
from millrace.operators import dashboard as B, evaluation as E, evidence as V, matching as M, packed, state
from millrace.plans import reference as R
from millrace.plans.dates_sql import instants_sql
from millrace.plans.problems import values_sql
from millrace.plans.reference import QUERIES as CORE, _company, _key, _norm, _tok, _trim  # noqa: F401
from millrace.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}

PROFILE = M.Profile.of(
    {
        "name": "sample", "roles": ["Engineer", "Business Intelligence Developer", "Database Administrator", "Analyst"], "keywords": ["tidal modelling", "pipelines", "acoustic measurement", "clusters"],
        "excludes": ["urgent", "unpaid"], "seniority": "senior", "remote": False, "location": "Fort Rhunekville", "greenhouse_boards": ["optics"], "lever_boards": [], "career_pages": [{"company": "Textiles", "url": "x"}], "sources": {"hirelark": True, "rolefeed": True},
    }
)
AS_OF = 1750000000 * 1_000_000


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _terms(words: list[str]) -> str:
    return "|".join("".join(ch if ch.isalnum() or ch in " _" else "\\" + ch for ch in w.lower()) for w in words)


def _any(hay: str, words: list[str]) -> str:
    return f"regexp_matches(lower({hay}), '\\b(?:{_terms(words)})\\b')"


_T = lambda c: f"coalesce({c}, '')"
_EXTRA = lambda k: f"coalesce(extra['{k}'], '')"
_YEARS = R._years().replace("coalesce(description, '')", "description")
_POSTING = f"""select raw_id, source_name, run_no, posted_date, {_T('title')} as title, {_T('company')} as company, {_T('location')} as location, {_T('description')} as description, {_T('apply_url')} as apply_url_direct, extra from raw_jobs"""
_POSTINGS = f"""select *, title as role, contains(lower(location), 'remote') or contains(lower(description), 'remote') or {_EXTRA('remote')} <> '' as remote, case when {_EXTRA('experience_needed')} <> '' then {_EXTRA('experience_needed')} else {_YEARS} end as experience_needed,
    {_EXTRA('salary')} as salary_if_present, {_EXTRA('seniority')} as seniority, {_EXTRA('valid_through')} as valid_through, sha1({_key('title')} || '|' || {_key('company')} || '|' || {_key('location')}) as job_id_hash from ({_POSTING})"""


# ---- projection and profile -------------------------------------------------------------------------------------
@query(f"select raw_id, role, remote, experience_needed, salary_if_present, seniority, valid_through, job_id_hash from ({_POSTINGS})")
def job_projection(spark: SparkSession, d: str) -> DataFrame:
    return M.postings(table(spark, d, "raw_jobs")).select("raw_id", "role", "remote", "experience_needed", "salary_if_present", "seniority", "valid_through", "job_id_hash")


_HAY = "title || ' ' || role || ' ' || description"
_ALLOWED = " or ".join(f"contains(lower(company), '{n}')" for n in PROFILE.allowed())
_LISTED = ", ".join(f"'{s}'" for s in M.ALLOWLISTED)
_PASS = f"""title not in ('', 'MISSING') and not {_any(_HAY, PROFILE.excludes)} and {_any(_HAY, PROFILE.roles)} and ({_any(_HAY, PROFILE.keywords)} or trim(description) = '')
    and (seniority = '' or contains(lower(seniority), '{PROFILE.seniority}')) and (source_name is null or source_name not in ({_LISTED}) or {_ALLOWED})"""


@query(f"select raw_id from ({_POSTINGS}) where {_PASS}")
def profile_filter(spark, d):
    """Postings that the sample profile accepts."""
    return M.titled(M.postings(table(spark, d, "raw_jobs"))).where(M.accepts(PROFILE)).select("raw_id")


@query("select job_row_id from jobs where title not in ('', 'MISSING') and (coalesce(role, '') = '' or contains(lower(role), 'senior')) and (source_name not in ('greenhouse', 'lever', 'career_page_generic', 'career_page_browser') or contains(lower(coalesce(company, '')), 'optics') or contains(lower(coalesce(company, '')), 'textiles'))")
def profile_seniority(spark, d):
    """The profile's seniority and allowlist alone, over the stored roles as seniority and each source name in turn."""
    p = M.Profile.of({"seniority": "Senior", "greenhouse_boards": ["Optics"], "career_pages": [{"company": "Textiles"}]})
    return M.titled(table(spark, d, "jobs")).withColumn("seniority", F.col("role")).where(M.accepts(p)).select("job_row_id")


_LIKELY = " or ".join(f"contains(lower(title || ' ' || company), '{t.lower()}')" for t in (*PROFILE.roles, *PROFILE.keywords))


@query(f"select raw_id, place from (select raw_id, row_number() over (order by ({_LIKELY}) desc, raw_id) as place from ({_POSTING})) where place <= 200")
def likely_first(spark, d):
    """The 200 postings that a budget would look at closely: likely ones first."""
    order = [M.likely(PROFILE).desc(), F.asc("raw_id")]
    rows = M.postings(table(spark, d, "raw_jobs")).orderBy(*order).limit(200)
    return rows.select("raw_id", F.row_number().over(Window.orderBy(*order)).alias("place"))


_ON = ", ".join(f"'{s}'" for s, use in sorted(PROFILE.sources.items()) if use)


@query(f"select source_name, raw_id from (select source_name, raw_id, row_number() over (partition by source_name order by run_no, raw_id) as k from raw_jobs where source_name in ({_ON})) where k <= 50")
def sources_topn(spark, d):
    """The first 50 rows of each source that the profile switches on."""
    rows = M.of_sources(table(spark, d, "raw_jobs").select("source_name", "run_no", "raw_id"), PROFILE)
    return M.first_of_each(rows, "source_name", ["run_no", "raw_id"], PROFILE.top_n).select("source_name", "raw_id")


_Q = PROFILE.query_terms()


@query(" union all ".join(f"select {i} as place, '{t}' as term" for i, t in enumerate(_Q, 1)))
def query_terms(spark, d):
    return spark.createDataFrame(list(enumerate(_Q, 1)), "place int, term string")


# ---- relevance --------------------------------------------------------------------------------------------------
def _cover(words: str) -> str:
    parts = " + ".join(f"(len(list_filter({words}, lambda x: x = '{w}')) * 2.5 / (len(list_filter({words}, lambda x: x = '{w}')) + 1.5))" for w in _Q)
    return f"least(1.0, ({parts}) / {len(_Q)})"


_SKILLS = [w for w in dict.fromkeys("".join(c for c in k.lower() if c.isalnum() or c == " ") for k in PROFILE.keywords)]
_SYN = "case x " + " ".join(f"when '{a}' then '{b}'" for a, b in X.SKILL_SYNONYMS.items()) + " else x end"
_OVER = f"len(list_intersect([{', '.join(repr(s) for s in _SKILLS)}], list_transform(list_concat(t, w), lambda x: {_SYN})))::double / {len(_SKILLS)}"
_PLACE = f"case when coalesce(location, '') = '' then 0.5 when lower({_trim('location')}) = lower('{PROFILE.location}') then 1.0 else {R._jaccard('lw', 'pw')} end"
_SCORED = f"""select raw_id, {_cover('t')} as title_cover, {_cover('w')} as text_cover, {_OVER} as skill_overlap, case when seniority = '' then 0.5 when contains(lower(seniority), '{PROFILE.seniority}') then 1.0 else 0.0 end as experience_compat,
    case when {_PLACE} >= 0.5 then 1.0 else 0.0 end as location_compat from (select *, {_tok(_norm('title'))} as t, {_tok(_norm('description'))} as w, list_distinct({_tok(R._loc('location'))}) as lw, list_distinct({_tok(R._loc(repr(PROFILE.location)))}) as pw from ({_POSTINGS}))"""


@query(f"select raw_id, round(title_cover, 6) as title_cover, round(text_cover, 6) as text_cover, round(skill_overlap, 6) as skill_overlap, experience_compat, location_compat, round(0.6 * (0.6 * title_cover + 0.4 * text_cover) + 0.2 * skill_overlap + 0.1 * experience_compat + 0.1 * location_compat, 6) as match_score from ({_SCORED})")
def score_match(spark, d):
    """Relevance of each posting to the sample profile, with its parts."""
    s = M.scores(M.postings(table(spark, d, "raw_jobs")), PROFILE)
    return s.select("raw_id", *[F.round(c, 6).alias(c) for c in ("title_cover", "text_cover", "skill_overlap")], "experience_compat", "location_compat", F.round("match_score", 6).alias("match_score"))


_TWICE = ["data", "remote", "data", "engineer"]
_PART = lambda w: f"(case when f_{w} > 0 then coalesce(i_{w}, 1.0) * f_{w} * 2.5 / (f_{w} + 1.5 * (0.25 + 0.75 * n / a)) else 0.0 end)"


@query(
    f"""with t as (select doc_id, {_tok(_norm('text'))} as t from documents), s as (select avg(len(t)) as a, count(*) as c from t),
        m as (select doc_id, len(t) as n, {', '.join(f"len(list_filter(t, lambda x: x = '{w}')) as f_{w}" for w in sorted(set(_TWICE)))} from t),
        g as (select {', '.join(f"ln(1 + (any_value(c) - count(*) filter (f_{w} > 0) + 0.5) / (count(*) filter (f_{w} > 0) + 0.5)) as i_{w}" for w in sorted(set(_TWICE)))} from m, s)
        select doc_id, round({' + '.join(_PART(w) for w in _TWICE)}, 6) as score from m, g, s where {' or '.join(f'f_{w} > 0' for w in sorted(set(_TWICE)))}"""
)
def bm25_scores(spark, d):
    """BM25 with mean length and weights of rarity over all documents; a term that is asked twice counts twice."""
    words = table(spark, d, "documents").select("doc_id", F.explode(F.array(X.tokens(X.normalize_text(F.col("text"))))).alias("t"))
    terms = sorted(set(_TWICE))
    stats = words.agg(F.avg(F.size("t")).alias("a"), F.count("*").alias("n"), *[F.count_if(F.array_contains("t", w)).alias(f"df_{w}") for w in terms]).first()
    idf = F.create_map(*[c for w in terms for c in (F.lit(w), F.log(F.lit(1 + (stats.n - stats[f"df_{w}"] + 0.5) / (stats[f"df_{w}"] + 0.5))))])
    held = words.where(F.arrays_overlap("t", F.array(*[F.lit(w) for w in terms])))
    return held.select("doc_id", F.round(M.bm25(_TWICE, F.col("t"), avgdl=F.lit(stats.a or 1.0), idf=idf), 6).alias("score"))


# ---- dates ------------------------------------------------------------------------------------------------------
def _dated_sql(values: str, keep: str, date: str = "date_posted") -> str:
    """keep, utc_micros and the calendar date of values (value, zone UTC, day first)."""
    local = "strftime(case when epoch is not null then make_timestamp(epoch) else ts end, '%Y-%m-%d')"
    return f"select {keep}, value, utc_micros, case when utc_micros is null then '' else {local} end as {date} from ({instants_sql(values)})"


_RAWDATES = _dated_sql("select raw_id, posted_date as value, 'UTC' as zone, true as day_first from raw_jobs where posted_date is not null", "raw_id")
_AGES = "case " + " ".join(f"when contains(lower(posted_date), '{w}') then '{label}'" for w, label in D.AGE_WORDS) + " else 'MISSING' end"
_BANDS = f"case when utc_micros is null then case when {R._blank('posted_date')} then 'MISSING' else {_AGES} end when ({AS_OF} - utc_micros) / 86400e6 <= 1 then 'fresh' when ({AS_OF} - utc_micros) / 86400e6 <= 7 then 'recent' when ({AS_OF} - utc_micros) / 86400e6 <= 30 then 'older' else 'stale' end"


@query(f"select r.raw_id, coalesce(v.date_posted, '') as date_posted, {_BANDS} as freshness, coalesce(utc_micros < {AS_OF}, false) as expired from raw_jobs r left join ({_RAWDATES}) v using (raw_id)")
def posting_dates(spark, d):
    """Calendar date, freshness and expiry of each posted date at a fixed instant."""
    rows = D.dated(table(spark, d, "raw_jobs").select("raw_id", "posted_date"), "posted_date", "x")
    at = F.lit(AS_OF)
    return rows.select("raw_id", F.col("x_date").alias("date_posted"), D.freshness(F.col("posted_date"), F.col("x_micros"), at).alias("freshness"), D.expired(F.col("x_micros"), at).alias("expired"))


_PHRASES = "case " + " ".join(f"when contains(lower(coalesce(posted_date, '')), '{p}') then '{p}'" for p in D.AGE_PHRASES) + " else '' end"


@query(f"select phrase, count(*) as n from (select {_PHRASES} as phrase from raw_jobs) group by phrase")
def age_phrases(spark, d):
    return table(spark, d, "raw_jobs").groupBy(D.age_phrase(F.col("posted_date")).alias("phrase")).agg(F.count("*").alias("n"))


# ---- evidence ---------------------------------------------------------------------------------------------------
_HINT = f"replace(regexp_replace({R._words_only('company')}, ' +(?:{'|'.join(X.HINT_SUFFIXES)})$', ''), ' ', '')"
_JOBDATES = _dated_sql("select job_row_id, valid_through as value, 'UTC' as zone, true as day_first from jobs where valid_through is not null", "job_row_id", "x")
_POSTED = _dated_sql("select job_row_id, date_posted as value, 'UTC' as zone, true as day_first from jobs where date_posted is not null", "job_row_id", "x")
_DOM = "lower(coalesce(employer_domain, ''))"
_PLUS = [("official_ats_source", "coalesce(source_authority, 0) >= 4"), ("official_domain", f"h <> '' and contains({_DOM}, h)"), ("valid_posting_id", "coalesce(posting_id, '') <> ''"), ("active_application", "authentic_status is distinct from 'CLOSED'"), ("current_posting", f"{AS_OF} - p.utc_micros <= 7 * 86400000000"), ("structured_job_posting", "lower(coalesce(source_name, '')) = 'google_jobs'"), ("cross_source_agreement", "ns > 1")]
_MINUS = [("expired_valid_through", f"coalesce(e.utc_micros < {AS_OF}, false)"), ("closed_state", "authentic_status is not distinct from 'CLOSED'"), ("employer_domain_mismatch", f"h <> '' and {_DOM} <> '' and not contains({_DOM}, h)"), ("broken_application", "coalesce(apply_url_direct, '') in ('', 'MISSING')")]
_MARKS = lambda marks: f"list_filter([{', '.join(f'''case when {c} then '{n}' end''' for n, c in marks)}], lambda x: x is not null)"
_SAY = "case x " + " ".join(f"when '{k}' then '{v}'" for k, v in V.REASONS.items()) + " else replace(x, '_', ' ') end"


@query(
    f"""select job_row_id, array_to_string(pos, ',') as positive, array_to_string(neg, ',') as negative, array_to_string(list_concat(list_transform(pos, lambda x: {_SAY}), list_transform(neg, lambda x: 'negative: ' || {_SAY})), '; ') as reasons
        from (select j.job_row_id, {_MARKS(_PLUS)} as pos, {_MARKS(_MINUS)} as neg from (select *, {_HINT} as h, len(list_distinct({values_sql('seen_sources', True)})) as ns from jobs) j left join ({_JOBDATES}) e using (job_row_id) left join ({_POSTED}) p using (job_row_id))"""
)
def evidence_signals(spark, d):
    """Signals for and against each stored posting at a fixed instant, and what is said for them."""
    jobs = table(spark, d, "jobs").select("job_row_id", "company", "employer_domain", "posting_id", "authentic_status", "source_name", "source_authority", "apply_url_direct", "valid_through", "date_posted", "seen_sources")
    jobs = packed.with_values(jobs, "seen_sources", packed.JOB_LISTS["seen_sources"], "sources")
    rows = D.dated(D.dated(jobs, "valid_through", "e"), "date_posted", "p")
    at = F.lit(AS_OF)
    # behind a generator: the signals are worked out once for their names and their texts
    fresh = F.when((at - F.col("p_micros")) <= 7 * D.DAY, "recent").otherwise("")
    marks = F.struct(V.positive_signals(F.coalesce("source_authority", F.lit(0)), fresh, F.size(F.array_distinct("sources"))).alias("p"), V.negative_signals(D.expired(F.col("e_micros"), at)).alias("n"))
    rows = rows.select("job_row_id", F.explode(F.array(marks)).alias("s"))
    return rows.select("job_row_id", F.array_join("s.p", ",").alias("positive"), F.array_join("s.n", ",").alias("negative"), F.array_join(V.reasons(F.col("s.p"), F.col("s.n")), "; ").alias("reasons"))


@query(f"select state, count(*) as n from (select case when authentic_status = 'CLOSED' then 'closed' when {R._blank('apply_url_direct')} then 'invalid_url' else 'open' end as state from jobs) group by state")
def job_states(spark, d):
    return table(spark, d, "jobs").groupBy(M.job_state(F.col("authentic_status"), F.col("apply_url_direct")).alias("state")).agg(F.count("*").alias("n"))


# ---- cross-run views --------------------------------------------------------------------------------------------
@query(f"select s as source_name, count(*) as n from (select unnest({values_sql('seen_sources', True)}) as s from jobs) group by s")
def source_counts(spark, d):
    jobs = packed.with_values(table(spark, d, "jobs").select("seen_sources"), "seen_sources", packed.JOB_LISTS["seen_sources"], "sources")
    return B.source_counts(jobs)


@query("select coalesce(nullif(decision, ''), 'NONE') as decision, count(*) as n from jobs group by 1")
def decision_counts(spark, d):
    return B.counted(table(spark, d, "jobs"), F.col("decision"), "decision", "NONE")


@query("select count(*) as total, count(*) filter (job_version = 1 and authentic_status is distinct from 'CLOSED') as new_count, count(*) filter (authentic_status = 'CLOSED') as closed_count, count(*) filter (contains(lower(location), 'remote')) as remote_count, coalesce(round(avg(match_score), 2), 0.0) as avg_match from jobs")
def dashboard_totals(spark, d):
    return B.totals(table(spark, d, "jobs"), F.col("job_version") == 1, F.col("authentic_status"), F.lower("location").contains("remote"), F.col("match_score"))


@query("select min(v) as first_seen, max(v) as last_seen from (select unnest([first_seen_at, try_cast(trim(date_posted) as double)]) as v from jobs) where v <> 0 and not isnan(v)")
def seen_range(spark, d):
    return B.seen_range(table(spark, d, "jobs"), ["first_seen_at", "date_posted"])


@query(f"select job_row_id, lower(coalesce(company, '')) as company_key from (select *, {values_sql('seen_sources', True)} as sources from jobs) where decision = 'REVIEW' and authentic_status = 'AUTHENTIC' and (source_name = 'rolefeed' or list_contains(sources, 'rolefeed')) and contains(lower(coalesce(title, '') || ' ' || coalesce(company, '')), 'engineer')")
def dashboard_filter(spark, d):
    """What the view's filters leave, with the key that a click on the company sorts by."""
    jobs = packed.with_values(table(spark, d, "jobs").select("job_row_id", "title", "company", "decision", "authentic_status", "source_name", "seen_sources"), "seen_sources", packed.JOB_LISTS["seen_sources"], "sources")
    rows = B.chosen(jobs, decision="REVIEW", status="AUTHENTIC", source="rolefeed", text=" Engineer ", texts=["title", "company"])
    return rows.select("job_row_id", B.sort_key("company").alias("company_key"))


@query("select job_row_id, case when match_score is null then '' else printf('%.2f', match_score) end as score_text, case when regexp_matches(run, '^\\d{8}-\\d{6}$') then strftime(strptime(run, '%Y%m%d-%H%M%S'), '%Y-%m-%d %H:%M') else run end as run_text from (select *, case when job_row_id % 2 = 0 then '20240131-235900' else source_name end as run from jobs)")
def score_texts(spark, d):
    jobs = table(spark, d, "jobs").withColumn("run", F.when(F.col("job_row_id") % 2 == 0, "20240131-235900").otherwise(F.col("source_name")))
    return jobs.select("job_row_id", B.score_text(F.col("match_score")).alias("score_text"), B.run_time_text(F.col("run")).alias("run_text"))


@query("select job_row_id, row_number() over (order by case decision when 'AUTO_ACCEPT' then 3 when 'REVIEW' then 2 else 0 end desc, case when coalesce(match_score, 0) <> 0 then match_score else coalesce(confidence_score, 0) end desc, first_seen_at nulls last, job_id_hash nulls last, job_row_id) as place from jobs qualify place <= 100")
def report_order(spark, d):
    """The first hundred rows of the report."""
    jobs = table(spark, d, "jobs")
    order = [*B.ranked(jobs), F.asc("job_row_id")]
    return jobs.orderBy(*order).limit(100).select("job_row_id", F.row_number().over(Window.orderBy(*order)).alias("place"))


# ---- candidates with the limit, and the store -------------------------------------------------------------------
_BOUND = f"""select id1, id2, tier, row_number() over (partition by id1 order by tier, id2) as place from ({R.SQL['candidate_tiers']}) qualify place <= 25"""


@query(_BOUND)
def bounded_candidates(spark, d):
    """As candidate_tiers, of each incoming row the first 25: that bound is the reference's."""
    c = CORE["candidate_tiers"](spark, d)
    top = M.first_of_each(c.select("id1", "tier", "id2"), "id1", ["tier", "id2"], 25)
    return top.select("id1", "id2", "tier", F.row_number().over(Window.partitionBy("id1").orderBy("tier", "id2")).alias("place"))


@query(
    f"""with b as (select a.id1, arg_max(a.id2, (a.tier = 0, a.score, -a.tier, -a.id2)) as matched_id from (select p.id1, p.id2, p.score, t.tier from ({R._pairs_sql()}) p join ({R.SQL['candidate_tiers']}) t using (id1, id2) where t.tier = 0 or p.verdict = 'auto_merge' union all
        select id1, id2, 1.0, 0 from ({R.SQL['candidate_tiers']}) where tier = 0) a group by a.id1),
        u as (select b.matched_id, i.* from incoming_jobs i join b on b.id1 = i.job_row_id),
        w as (select matched_id, arg_max(apply_url_direct, (arrived_at, job_row_id)) as url, max(epoch_us(arrived_at)) / 1e6 as seen, list_distinct(list(source_name) filter (source_name <> '')) as names from u group by 1)
        select j.job_row_id, coalesce(w.seen, j.last_seen_at) as last_seen_at, j.title, case when w.matched_id is null then j.apply_url_direct else w.url end as apply_url_direct, w.matched_id is not null as merged,
        len(list_distinct(list_concat([s for s in [j.source_name] if s <> ''], coalesce(w.names, [])))) as n_sources from jobs j left join w on w.matched_id = j.job_row_id"""
)
def merge_state(spark, d):
    """Incoming rows merged into the stored row that they match: an equal hash, or the best one that scores high enough under an equal posting id."""
    jobs, incoming = table(spark, d, "jobs"), table(spark, d, "incoming_jobs")
    tiers = CORE["candidate_tiers"](spark, d)
    exact = tiers.where("tier = 0").select("id1", "id2", "tier", F.lit(1.0).alias("score"))
    fuzzy = CORE["composite_pairs"](spark, d).where("verdict = 'auto_merge'").join(tiers.where("tier > 0"), ["id1", "id2"]).select("id1", "id2", "tier", "score")
    matches = state.best_match(exact.unionByName(fuzzy))
    held = jobs.select("job_row_id", "last_seen_at", "title", "apply_url_direct", F.filter(F.array("source_name"), lambda s: s.isNotNull() & (s != "")).alias("source_names"))
    batch = incoming.select(F.col("job_row_id").alias("id1"), (F.unix_micros("arrived_at") / 1e6).alias("seen"), "source_name", "apply_url_direct")
    out = state.merged(held, batch.join(matches, "id1"), "job_row_id", "id2", ["apply_url_direct"])
    return out.select("job_row_id", "last_seen_at", "title", "apply_url_direct", "merged", F.size("source_names").alias("n_sources"))


@query()
def pair_benchmark(spark, d):
    """Precision, recall and F1 of the composite similarity on pairs made of the stored postings, at its thresholds."""
    return E.prf(E.pair_scores(E.labelled_pairs(table(spark, d, "jobs"), "job_row_id")), "label", "score", [0.75, 0.80, 0.88])


# ---- texts ------------------------------------------------------------------------------------------------------
_PAGE = f"substr({_trim(f"regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '(?is)<script\\b.*?</script>|<style\\b.*?</style>', ' ', 'g'), '(?s)<[a-zA-Z/!][^>]*>', ' ', 'g'), '{R.WS}+', ' ', 'g')")}, 1, 4000)"


@query(f"select doc_id, md5({_PAGE}) as text_md5 from documents")
def page_texts(spark, d):
    """The shown text of each document as a page, entities as they stand."""
    return table(spark, d, "documents").select("doc_id", F.md5(X.page_text(F.col("text"))).alias("text_md5"))


@query(f"select raw_id, len(k) as n_keywords, array_to_string(k, '|') as keywords from (select raw_id, list_filter(list_transform(string_split_regex(coalesce(title, '') || ';' || coalesce(location, ''), '[,;/]'), lambda x: {_trim('x')}), lambda x: x not in ('', 'MISSING')) as k from raw_jobs)")
def keyword_lists(spark, d):
    rows = table(spark, d, "raw_jobs").select("raw_id", X.keyword_list(F.concat_ws(";", F.coalesce("title", F.lit("")), F.coalesce("location", F.lit("")))).alias("k"))
    return rows.select("raw_id", F.size("k").alias("n_keywords"), F.array_join("k", "|").alias("keywords"))


@query("select raw_id, extra['tags'] is not null as has_object from raw_jobs")
def json_objects(spark, d):
    """An answer around each posting's tags, and whether its object is found."""
    tags = F.try_element_at("extra", F.lit("tags"))
    answer = F.when(tags.isNull(), F.lit("no answer {")).otherwise(F.concat(F.lit('Here: ```json\n{"tags": '), tags, F.lit("}\n``` done")))
    return table(spark, d, "raw_jobs").select("raw_id", X.json_object(answer).isNotNull().alias("has_object"))

"""Profile filter, relevance, dates, evidence, cross-run views, sinks and landed cards on small tables."""

import csv
import json
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import dates as D, text as X
from millrace.operators import dashboard as B, evaluation as E, evidence as V, matching as M, state
from millrace.plans import pipeline
from millrace.sinks import reports as K
from millrace.sources import feeds as S
from tests.test_queries import DATA, duck, rows  # noqa: F401


@pytest.mark.parametrize("name", sorted(pipeline.SQL))
def test_query_agrees_with_its_sql(spark, duck, name):  # noqa: F811
    assert rows(pipeline.QUERIES[name](spark, str(DATA)).toPandas()) == rows(duck.sql(pipeline.SQL[name]).df())


JOB = "title string, role string, description string, seniority string, company string, source_name string"


def accepted(spark, profile, *jobs):
    df = spark.createDataFrame([(i, *j) for i, j in enumerate(jobs)], f"i int, {JOB}")
    return [r.i for r in df.where(M.accepts(M.Profile.of(profile))).orderBy("i").collect()]


def test_profiles(spark):
    job = ("Backend Engineer", None, "python and sql", "Senior", "Acme", "remoteok")
    assert accepted(spark, {}, job, (None,) * 6) == [0, 1]
    assert accepted(spark, {"roles": ["engineer"]}, job, ("Engineering", "", "", "", "", "")) == [0]
    assert accepted(spark, {"excludes": ["sql"]}, job, ("Nurse", "", "nosql", "", "", "")) == [1]
    # a posting without description isn't asked for keywords
    assert accepted(spark, {"keywords": ["rust"]}, job, ("Nurse", "", " ", "", "", "")) == [1]
    assert accepted(spark, {"seniority": "senior"}, job, ("Nurse", "", "", "junior", "", ""), ("Nurse", "", "", None, "", "")) == [0, 2]
    assert accepted(spark, {"greenhouse_boards": ["acme"]}, (*job[:4], "Acme Labs", "greenhouse"), (*job[:4], "Other", "greenhouse"), (*job[:4], "Other", "remoteok")) == [0, 2]
    old = M.Profile.of({"company_allowlist": ["stripe", {"company": "Acme", "url": "u"}], "unknown": 1})
    assert old.greenhouse_boards == ["stripe", "Acme"] and old.career_pages == [{"company": "Acme", "url": "u"}] and old.allowed() == ["acme", "stripe"]
    assert M.Profile.of({"sources": {"jobicy": False}}).sources["jobicy"] is False and M.Profile.of({}).sources["indeed"] is False


def test_profile_file(tmp_path):
    (tmp_path / "p.yaml").write_text(json.dumps({"name": "n", "roles": ["R"], "remote": False}))
    p = M.Profile.load(str(tmp_path / "p.yaml"))
    assert (p.name, p.roles, p.remote, p.top_n) == ("n", ["R"], False, 50)


def test_relevance(spark):
    words = F.array(*[F.lit(w) for w in "data engineer data".split()])
    empty = F.array().cast("array<string>")
    one = spark.range(1).select(M.bm25(["data", "engineer"], words).alias("a"), M.bm25(["data", "data"], words).alias("b"), M.bm25(["x"], words).alias("c"), M.bm25([], words).alias("d"), M.bm25_coverage(["data"], empty).alias("e"), M.bm25(["data"], words, avgdl=F.lit(6.0), idf=F.create_map(F.lit("data"), F.lit(2.0))).alias("f")).first()
    assert one.a == pytest.approx(2 * 2.5 / 3.5 + 2.5 / 2.5) and one.b == pytest.approx(2 * 2 * 2.5 / 3.5) and (one.c, one.d, one.e) == (0, 0, 0)
    assert one.f == pytest.approx(2 * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / 6)))
    p = M.Profile.of({"keywords": ["JS", "C++", "go"]})
    df = spark.createDataFrame([("js dev", "Paris", True, "Senior"), (None, None, None, None)], "title string, location string, remote boolean, seniority string").withColumn("description", F.lit(None).cast("string"))
    got = M.scores(df, p).collect()
    assert got[0].skill_overlap == pytest.approx(1 / 3) and got[1].skill_overlap == 0 and got[0].location_compat == 1 and got[1].location_compat == 0 and got[0].experience_compat == 0.5
    neutral = M.scores(df, M.Profile.of({"remote": False})).first()
    assert neutral.match_score == pytest.approx(0.6 * 0.5 + 0.2 * 0.5 + 0.1 * 0.5 + 0.1 * 0.5)


def test_postings(spark):
    raw = spark.createDataFrame([("T", "C", "Remote", None, "2024-03-05T23:30:00-05:00", "u", {"salary": "1", "valid_through": "x"}, 1), (None, None, None, "3 years", "garbage", None, None, 2)], "title string, company string, location string, description string, posted_date string, apply_url string, extra map<string,string>, raw_id int")
    a, b = M.postings(raw, F.lit(1709700000 * 1_000_000)).orderBy("raw_id").collect()
    assert (a.role, a.remote, a.salary_if_present, a.valid_through, a.date_posted, a.freshness, a.missing_fields) == ("T", True, "1", "x", "2024-03-05", "fresh", [])
    assert (b.remote, b.experience_needed, b.missing_fields, b.freshness) == (False, "3+ years", ["title", "company", "apply_url_direct", "date_posted"], "MISSING")
    assert M.titled(M.postings(raw)).count() == 1


def test_dates(spark):
    at = 1_700_000_000
    cases = {"2023-11-14T23:30:00+05:30": ("2023-11-14", "fresh"), "1699000000": ("2023-11-03", "older"), "1699999999000": ("2023-11-14", "fresh"), "Wed, 08 Nov 2023 10:00:00 GMT": ("2023-11-08", "recent"), "01/02/2023": ("2023-02-01", "stale"), "2099-01-01": ("2099-01-01", "fresh"), "1 day ago": ("", "fresh"), "2 weeks ago": ("", "recent"), "??": ("", "MISSING"), "": ("", "MISSING"), "missing": ("", "MISSING")}
    df = spark.createDataFrame([(i, c) for i, c in enumerate([*cases, None])], "i int, t string")
    got = D.dated(df, "t", "x").select("i", "x_date", D.freshness(F.col("t"), F.col("x_micros"), F.lit(at * 1_000_000)), D.expired(F.col("x_micros"), F.lit(at * 1_000_000))).orderBy("i").collect()
    assert [(r[1], r[2]) for r in got] == [*cases.values(), ("", "MISSING")]
    assert [r[3] for r in got][:3] == [True, True, True] and not got[5][3] and not got[-1][3]
    ages = spark.createDataFrame([("Posted 2 days ago", ""), ("Active 1 day ago", ""), (None, ""), ("5 weeks ago", "")], "t string, x string").select(D.age_phrase(F.col("t"))).collect()
    assert [r[0] for r in ages] == ["2 days ago", "1 day ago", "", "weeks ago"]


def test_evidence(spark):
    jobs = spark.createDataFrame([("Acme Inc", "jobs.acme.com", "7", "AUTHENTIC", "google_jobs", "https://a"), ("Acme", "other.com", "", "CLOSED", "x", "MISSING")], "company string, employer_domain string, posting_id string, authentic_status string, source_name string, apply_url_direct string")
    plus = [r[0] for r in jobs.select(V.positive_signals(F.lit(4), F.lit("recent"), F.lit(2))).collect()]
    assert plus[0] == ["official_ats_source", "official_domain", "valid_posting_id", "active_application", "current_posting", "structured_job_posting", "cross_source_agreement"] and plus[1] == ["official_ats_source", "current_posting", "cross_source_agreement"]
    minus = [r[0] for r in jobs.select(V.negative_signals(F.lit(True))).collect()]
    assert minus == [["expired_valid_through"], ["expired_valid_through", "closed_state", "employer_domain_mismatch", "broken_application"]]
    assert jobs.select(V.reasons(F.array(F.lit("official_domain")), F.array(F.lit("some_thing")))).first()[0] == ["apply URL on employer domain", "negative: some thing"]


def test_probes(spark):
    urls = ["ok", "gone", "filled", "block", "down", "unseen", "", "late", "moved"]
    jobs = spark.createDataFrame([(u, "", "AUTHENTIC", u == "late") for u in urls], "apply_url_direct string, employer_domain string, authentic_status string, late boolean")
    probes = spark.createDataFrame([("ok", 200, "fine", None), ("gone", 404, "", None), ("filled", 200, "Sorry, this position has been filled", None), ("block", 403, "", None), ("down", None, None, None), ("late", 200, "", None), ("moved", 200, "fine", "https://www.acme.com/careers/1")], "apply_url_direct string, status_code int, body string, final_url string")
    got = {r.apply_url_direct: r for r in V.verified(jobs, probes, F.col("late")).collect()}
    assert {u for u, r in got.items() if r.authentic_status == "CLOSED"} == {"gone", "filled", "down", "", "late"}
    assert got["filled"].probe.position_filled and got["block"].probe.blocked and got["unseen"].probe is None
    assert got["https://www.acme.com/careers/1"].employer_domain == "acme.com"


def test_views(spark):
    df = spark.createDataFrame([(["a", "b"], "AUTO_ACCEPT", "AUTHENTIC", True, 0.5, "1700000000", "Zed"), (["a"], "", "CLOSED", True, None, "2024-01-01", "abc"), (None, None, None, None, 0.26, None, None)], "sources array<string>, decision string, authentic_status string, new boolean, score double, seen string, title string").withColumn("source_name", F.lit("s"))
    assert [tuple(r) for r in B.source_counts(df).collect()] == [("a", 2), ("b", 1)]
    assert [tuple(r) for r in B.counted(df, F.col("decision"), "d", "NONE").collect()] == [("NONE", 2), ("AUTO_ACCEPT", 1)]
    assert tuple(B.totals(df, F.col("new"), F.col("authentic_status"), F.lit(False), F.col("score")).first()) == (3, 1, 1, 0, 0.38)
    assert tuple(B.seen_range(df, ["seen"]).first()) == (1.7e9, 1.7e9)
    assert B.chosen(df, source="b").count() == 1 and B.chosen(df, text="ZE", texts=["title"]).count() == 1 and B.chosen(df, decision="AUTO_ACCEPT", status="CLOSED").count() == 0
    assert [r[0] for r in df.select(B.score_text(F.col("score"))).collect()] == ["0.50", "", "0.26"]


def test_first_of_each(spark):
    rng = random.Random(1)
    data = [("hot" if rng.random() < 0.6 else rng.choice("abc"), rng.randrange(50), i) for i in range(400)]
    df = spark.createDataFrame(data, "k string, o int, i int").repartition(5)
    got = sorted(tuple(r) for r in M.first_of_each(df, "k", ["o", "i"], 7).collect())
    want = sorted(x for k in {d[0] for d in data} for x in sorted((d for d in data if d[0] == k), key=lambda d: (d[1], d[2]))[:7])
    assert got == want


def test_merge_and_steps(spark):
    held = spark.createDataFrame([(1, 10.0, "T1", "u1", ["a"]), (2, 10.0, "T2", "u2", None)], "job_row_id long, last_seen_at double, title string, apply_url_direct string, source_names array<string>")
    batch = spark.createDataFrame([(7, 1, 20.0, "b", "n7"), (8, 1, 30.0, "a", None), (9, 1, 30.0, "c", "n9")], "id1 long, id2 long, seen double, source_name string, apply_url_direct string")
    got = {r.job_row_id: r for r in state.merged(held, batch, "job_row_id", "id2", ["apply_url_direct"]).collect()}
    assert (got[1].last_seen_at, got[1].title, got[1].apply_url_direct, got[1].source_names, got[1].merged) == (30.0, "T1", "n9", ["a", "b", "c"], True)
    assert (got[2].last_seen_at, got[2].apply_url_direct, got[2].source_names, got[2].merged) == (10.0, "u2", [], False)
    best = state.best_match(spark.createDataFrame([(1, 5, 1, 0.9), (1, 6, 0, 0.1), (2, 8, 2, 0.9), (2, 7, 2, 0.9)], "id1 long, id2 long, tier int, score double"))
    assert {tuple(r) for r in best.collect()} == {(1, 6), (2, 7)}
    new, again = state.stepped(spark.createDataFrame([("a",)], "job_id_hash string"), spark.createDataFrame([("a", 1, 1), ("b", 1, 2), ("b", 0, 3)], "job_id_hash string, seen int, row_id int"))
    assert [r.row_id for r in new.collect()] == [3] and sorted(r.row_id for r in again.collect()) == [1, 2]
    moved = state.migrated(spark.createDataFrame([("h", 5)], "job_id_hash string, title int"), "job_id_hash string, title string, decision string")
    assert moved.collect()[0].asDict() == {"job_id_hash": "h", "title": "5", "decision": None}
    assert state.migrated(spark.createDataFrame([("h", "p")], "job_id_hash string, placeholder string"), "job_id_hash string, title string").count() == 0


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("<b>T</b>", "CLOSED", False, ["x", "y"], 0.5, "javascript:alert(1)"), ('a "q", c', "AUTHENTIC", True, [], 0.9, "https://u"), (None, None, None, None, None, None)], "title string, authentic_status string, genuinely_new boolean, seen_sources array<string>, match_score double, apply_url_direct string")
    K.write_csv(df, str(tmp_path / "csv"), [F.desc("match_score")], one_file=True)
    (file,) = (tmp_path / "csv").glob("*.csv")
    lines = list(csv.reader(file.open(encoding="utf-8")))
    assert lines[0] == K.CSV_COLUMNS and len(lines[0]) == 34 and [r[2] for r in lines[1:]] == ['a "q", c', "<b>T</b>", ""] and lines[2][20] == "x, y"
    K.write_json(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 3
    K.write_page(df, str(tmp_path / "r.html"), "R & D")
    page = (tmp_path / "r.html").read_text()
    assert "&lt;b&gt;T" in page and "javascript:" not in page and 'class="closed"' in page and "3 postings, 1 new, 1 closed" in page
    K.write_dashboard(df.withColumn("title", F.lit("</script>")), spark.createDataFrame([("r", 1)], "run string, n int"), {"decisions": spark.createDataFrame([("A", 1)], "d string, n int")}, str(tmp_path / "d.html"), "D")
    assert (tmp_path / "d.html").read_text().count("</script>") == 1
    one = K.run_summary(df, df, spark.createDataFrame([("s", "ok"), ("s", "ok"), ("t", None)], "source_name string, status string"), "20240101-000000").first()
    assert (one.total_raw, one.new_count, one.closed_count, one.source_statuses) == (3, 1, 1, {"s": "ok", "t": ""})


def test_portal_and_anchor_cards(spark):
    cards = spark.createDataFrame([("u", 1, " Dev ", "C", None, "/jobs/view/1", "posted 2 days ago", "9"), ("u", 2, "Dev", "C", "X", "", "", ""), ("u", 3, "Ops", "C", "X", "https://a/b", None, None)], "source_url string, place int, title string, company string, location string, href string, body string, stipend string")
    got = S.portal_cards(cards, "linkedin", "Here", top_n=1).collect()
    assert [(r.title, r.location, r.apply_url, r.posted_date, r.extra) for r in got] == [("Dev", "Here", "https://www.linkedin.com/jobs/view/1", "2 days ago", {"salary": "9"})]
    assert S.portal_cards(cards.drop("stipend", "body"), "naukri").count() == 2
    links = spark.createDataFrame([("p", 1, "https://x/jobs/1", "Data Engineer\nlong line " + "x" * 80 + "\nPune, India", "C"), ("p", 2, "https://x/jobs/1", "Data Engineer again", "C"), ("p", 3, "https://x/jobs/2", "View all jobs", "C"), ("p", 4, "https://x/about", "Data Engineer", "C"), ("p", 5, "https://x/job/3", "Short", "C")], "source_url string, place int, href string, text string, company string")
    assert [(r.title, r.location, r.apply_url) for r in S.anchor_cards(links).collect()] == [("Data Engineer", "Pune, India", "https://x/jobs/1")]
    assert S.listing_slug(["C++ / Go"], []) == "c-go" and S.listing_slug([], ["Data Engineer"]) == "data-engineer" and S.listing_slug([], []) == "internship"
    page = spark.createDataFrame([('x {"@type": "JobPosting", "title": "T", "url": "z"} y {"a": 1} {"@type": "JobPosting" broken}', "u"), (None, "u")], "payload string, source_url string")
    assert [(r.title, r.apply_url) for r in S.flat_postings(page).collect()] == [("T", "z")]


def test_archive_and_pairs(spark, tmp_path):
    for ts, body in (("20240101-000000", '[{"job_id_hash": "h", "title": "A"}]'), ("20240102-000000", '[{"job_id_hash": "h", "title": "B"}, {"title": "C"}]'), ("20240103-000000", "{broken")):
        (tmp_path / ts).mkdir()
        (tmp_path / ts / "report.json").write_text(body)
    got = S.report_archive(spark, str(tmp_path)).where("title is not null").select("run_ts", "title").collect()
    assert sorted(map(tuple, got)) == [("20240101-000000", "A"), ("20240102-000000", "B"), ("20240102-000000", "C")]
    (tmp_path / "pairs.jsonl").write_text('{"a": {"title": "x"}, "b": {"title": "y"}, "label": 1}\n\n')
    assert S.read_pairs(spark, str(tmp_path / "pairs.jsonl")).first().a.title == "x"


def test_labelled_pairs(spark):
    df = spark.createDataFrame([(i, f"Title {i}", f"C{i % 7}", "L", "one two three four five six seven eight nine ten eleven twelve " * 3, "https://u") for i in range(200)] + [(999, None, None, None, None, None)], "job_row_id long, title string, company string, location string, description string, apply_url_direct string")
    pairs = E.labelled_pairs(df, "job_row_id", buckets=4).cache()
    n = dict(pairs.groupBy("label").count().collect())
    assert n[1] == 200 and 150 <= n[0] <= 200 and pairs.exceptAll(E.labelled_pairs(df.repartition(5), "job_row_id", buckets=4)).count() == 0
    got = {round(r.threshold, 2): r for r in E.prf(E.pair_scores(pairs), "label", "score", [0.75]).collect()}
    assert got[0.75].recall > 0.5
    assert E.labelled_pairs(df.limit(0), "job_row_id").count() == 0


def test_texts(spark):
    df = spark.createDataFrame([("<p>a &amp; b&#8212;c</p>", '{"x": {"y": "}"}}'), ("plain", "```json\n{\"a\": 1}\n```"), (None, None), ("<script>x</script> Show More Show Less z", "no { object")], "h string, j string")
    got = df.select(X.description_text(F.col("h")), X.json_object(F.col("j")), X.guest_text(F.col("h"))).collect()
    assert [r[0] for r in got] == ["a & b—c", "plain", "", "Show More Show Less z"] and [r[1] for r in got][1:] == ['{"a": 1}', None, None]
    assert got[3][2] == ""


def test_source_rules(spark):
    rows = spark.createDataFrame([("greenhouse", "https://b/jobs/12345"), ("lever", "https://jobs.lever.co/acme/abcd-1234"), ("remoteok", "https://remoteok.com/l/98765-dev"), ("adzuna", "https://a/ad/4321"), ("linkedin", "https://l/jobs/view/7654321"), ("other", "https://o/12345678?x"), ("other", "https://o/1")], "s string, u string")
    from millrace.functions.urls import posting_id

    assert [r[0] for r in rows.select(posting_id(F.col("s"), F.col("u"))).collect()] == ["12345", "abcd-1234", "98765", "4321", "7654321", "12345678", ""]
    assert S.search_json(spark.createDataFrame([('{"results": [{"title": "T", "location": {"display_name": "Leeds"}}]}', "u")], "payload string, source_url string"), "gb").first().location == "Leeds, UK"
    status = spark.createDataFrame([(200, "x" * 3000 + " Rate Limit", 0), (200, "Verify you are human", 0)], "s int, b string, n int")
    assert [r[0] for r in status.select(S.outcome(F.col("s"), F.col("b"), F.col("n"))).collect()] == ["rate_limited", "blocked"]

import json

from pyspark.sql import functions as F

from millrace.sources import feeds as S
from millrace.streaming.upserts import first_sights, run_available, snapshot


def landed(spark, *bodies, **more):
    rows = [{"payload": b, "source_url": "u", **more} for b in bodies]
    return spark.createDataFrame(rows, "payload string, source_url string" + "".join(f", {k} string" for k in more))


def test_json_feeds(spark):
    body = json.dumps([{"legal": "x"}, {"slug": "a", "position": "Eng", "company": "C", "url": "/jobs/1", "tags": ["py"], "date": "1700000000"}])
    r = S.slug_json(landed(spark, body, "no json", None)).collect()
    assert len(r) == 1 and r[0].title == "Eng" and r[0].apply_url == "https://remoteok.com/jobs/1" and r[0].extra == {"tags": '["py"]'}
    body = json.dumps({"results": [{"title": "T", "location": {"display_name": "Pune"}, "company": {"display_name": "C"}, "url": "x"}]})
    r = S.search_json(landed(spark, body), "India").collect()[0]
    assert (r.location, r.apply_url, r.company) == ("Pune, India", "x", "C")
    body = json.dumps({"SearchResult": {"SearchResultItems": [{"MatchedObjectDescriptor": {"PositionTitle": "T", "ApplyURI": ["a", "b"], "PositionRemuneration": [{"MinimumRange": "1", "MaximumRange": "2"}]}}]}})
    r = S.government_json(landed(spark, body)).collect()[0]
    assert r.apply_url == "a" and r.extra == {"salary_min": "1", "salary_max": "2"}
    r = S.board_json(landed(spark, json.dumps({"jobs": [{"title": "T", "location": {}, "offices": [{"name": "X"}, {"name": "Y"}]}]}), board="big-corp")).collect()[0]
    assert (r.company, r.location) == ("Big Corp", "X, Y")
    assert S.posting_json(landed(spark, json.dumps([{"text": "T"}]), board="b")).collect()[0].location == "Remote"


def test_rss(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>Acme: Eng</title><link>l</link></item><item><title>Beta - Dev</title><author>B</author></item></channel></rss>")
    rows = {r.title: r.company for r in S.rss_items(spark, str(tmp_path / "f.xml"), "weworkremotely", company_first=True).collect()}
    assert rows == {"Eng": "Acme", "Beta - Dev": "B"}
    assert {r.company for r in S.rss_items(spark, str(tmp_path / "f.xml"), "remotive").collect()} == {"", "B"}


def test_cards_and_details(spark):
    page = '<ul><li><a href="/x?a=1&amp;b=2"><h3 class="card-title">Eng</h3></a><h4 class="subtitle">C</h4><time datetime="2024-01-02"></time></li><li>none</li></ul>'
    cards = S.html_cards(landed(spark, page, "", None), default_place="Here")
    r = cards.collect()
    assert [(x.title, x.company, x.location, x.posted_date, x.apply_url) for x in r] == [("Eng", "C", "Here", "2024-01-02", "/x?a=1&b=2")]
    details = spark.createDataFrame([("/x?a=1&b=2", "long")], "apply_url string, description string")
    assert S.filled(cards, details).collect()[0].description == "long"


def test_json_ld(spark):
    node = {"@type": ["Thing", "JobPosting"], "title": "T", "hiringOrganization": {"name": "C"}, "jobLocation": [{"address": {"addressLocality": "L", "addressCountry": {"name": "N"}}}], "baseSalary": {"currency": "EUR", "value": {"minValue": 1, "maxValue": 2}}, "validThrough": "2030"}
    page = lambda x: f'<script type="application/ld+json">{x}</script>'
    rows = S.json_ld(landed(spark, page(json.dumps({"@graph": [node, {"@type": "Org"}]})), page("{bad"), page(json.dumps([node])), None)).collect()
    assert [(r.title, r.company, r.location, r.extra) for r in rows] == [("T", "C", "L, N", {"salary": "1-2 EUR", "valid_through": "2030"})] * 2
    both = S.union({"career_page_generic": landed(spark, page(json.dumps(node))), "remoteok": landed(spark, "[]")})
    assert both.count() == 1


def test_outcomes(spark):
    df = spark.createDataFrame([(429, "", 1), (401, "", 0), (503, "", 0), (403, "", 0), (200, "Are you a robot?", 0), (200, "", None), (200, "", 0), (200, None, 5)], "s int, b string, n int")
    assert [r[0] for r in df.select(S.outcome(F.col("s"), F.col("b"), F.col("n"))).collect()] == ["rate_limited", "auth_required", "source_down", "blocked", "blocked", "parse_failure", "empty", "ok"]


def test_stream_of_batches(spark, tmp_path):
    schema = "job_id_hash string, source_name string, arrived_at timestamp"
    put = lambda rows: spark.createDataFrame(rows, "job_id_hash string, source_name string, t string").select("job_id_hash", "source_name", F.col("t").cast("timestamp").alias("arrived_at")).write.mode("append").parquet(str(tmp_path / "in"))
    put([("A", "s1", "2024-01-01"), ("a", "s2", "2024-01-02"), (None, "s", "2024-01-01")])
    run_available(spark, str(tmp_path / "in"), schema, str(tmp_path))
    put([("a", "s3", "2024-01-05"), ("b", "s1", "2024-01-06")])
    run_available(spark, str(tmp_path / "in"), schema, str(tmp_path))
    rows = {r.job_id_hash: (r.source_names, r.last_seen - r.first_seen) for r in snapshot(spark, str(tmp_path / "state")).collect()}
    assert rows == {"a": (["s1", "s2", "s3"], 4 * 86400), "b": (["s1"], 0)}
    q = first_sights(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("firsts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select job_id_hash from firsts where job_id_hash = 'a'").count() == 1

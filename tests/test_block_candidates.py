"""The candidate join over all tiers, against brute force."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import blocking
from millrace.plans import reference as R

COLS = ["job_row_id", "job_id_hash", "title", "company", "location", "description", "apply_url_direct", "employer_domain", "posting_id", "block_key"]
TYPES = "job_row_id long, job_id_hash string, title string, company string, location string, description string, apply_url_direct string, employer_domain string, posting_id string, block_key string"
TEXT = "we need one person who runs the night audits of the whole site"
# stored: by hash, canonical id, URL, posting id, a block key, two tiers at once, nothing
STORED = [
    (1, "H1", "Cook", "Abc Inc", "Here", TEXT, None, None, None, None, None, None),
    (2, "h2", "Data Engineer", "Abc", "There", TEXT, None, "abc.example", None, None, " POSTING:77 ", None),
    (3, None, "Data Engineer", "Other", "There", "", None, None, None, None, None, "https://abc.example/x"),
    (4, None, "Data Enginer", "Other", None, TEXT, None, None, "77", None, None, None),
    (5, None, "Senior Data Engineer", "Abc", "Here", TEXT + " today", None, None, None, '"q|1";"abc|data engineer"', None, None),
    (6, "h1", "Data Engineer", "Abc", "Here", TEXT, None, None, "77", "abc|data engineer", "posting:77", "MISSING"),
    (7, "h7", "Florist", "Elsewhere", "Far", "none", "missing", "", " ", "z|z", "ct:z|z", "missing"),
]
INCOMING = [
    (101, "h1", "Data Engineer", "Abc Inc.", "Here", TEXT, "HTTPS://www.abc.example/x/?utm_a=1", "abc.example", " 77", "abc|data engineer, q|1"),
    (102, None, "Data Engineer", "Abc", "Here", TEXT, "MISSING", None, None, None),
    (103, "h9", "Pilot", "Nobody", "Sky", TEXT, "missing", None, "MISSING", "q|9"),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(STORED, TYPES + ", canonical_job_id string, canonical_url string").write.parquet(f"{d}/jobs.parquet")
    spark.createDataFrame(INCOMING, TYPES).write.parquet(f"{d}/incoming_jobs.parquet")
    return str(d)


WANT = {(101, 1): 0, (101, 6): 0, (101, 2): 1, (101, 3): 2, (101, 4): 2, (101, 5): 3, (102, 5): 3, (102, 6): 3}


def test_all_tiers_meet(spark, folder):
    assert {(r.id1, r.id2): r.tier for r in R.block_candidates(spark, folder).collect()} == WANT
    rows = R.block_pairs(spark, folder).collect()
    assert len(rows) == len(WANT) and {(r.id1, r.id2): r.tier for r in rows} == WANT


def test_scores_are_those_of_all_pairs(spark, folder):
    a, b = (spark.read.parquet(f"{folder}/{t}.parquet").select(F.col("job_row_id").alias(f"id{i}"), *[F.col(c).alias(f"{c}{i}") for c in R.FIELDS]) for i, t in ((1, "incoming_jobs"), (2, "jobs")))
    every = {(r.id1, r.id2): (round(r.score, 6), r.verdict) for r in blocking.scored(a.crossJoin(b)).collect()}
    got = {(r.id1, r.id2): (r.score, r.verdict) for r in R.block_pairs(spark, folder).collect()}
    assert got == {p: (1.0, "auto_merge") if tier == 0 else every[p] for p, tier in WANT.items()}
    # an equal hash wins over better texts; among equal hashes the smaller id
    best = {r.id1: (r.best_id, r.score) for r in R.block_best(spark, folder).collect()}
    assert best == {101: (1, 1.0), 102: (max((5, 6), key=lambda i: every[102, i][0]), max(every[102, 5][0], every[102, 6][0]))}

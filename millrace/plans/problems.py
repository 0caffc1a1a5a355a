"""Queries of the general problems (1 and 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.operators.packed import JOB_LISTS, explode_packed
from millrace.operators.timestamps import estimate_zones, normalise_instants, resolved_feeds
from millrace.plans.dates_sql import instants_sql
from millrace.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return explode_packed(table(spark, d, "jobs"), "job_row_id", JOB_LISTS)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    raw, jobs = table(spark, d, "raw_jobs"), table(spark, d, "jobs")
    feeds = resolved_feeds(table(spark, d, "feed_sources"), raw)
    return normalise_instants(spark, [("raw_jobs", raw, "raw_id", ["posted_date"]), ("jobs", jobs, "job_row_id", ["date_posted", "valid_through"])], feeds)


def p5_zones(spark: SparkSession, d: str) -> DataFrame:
    """source_name, declared, estimated, lag_s: each feed's zone as estimated from the ingestion times alone, all zones masked, and the mean seconds by which it misplaces the feed's local times."""
    raw, feeds = table(spark, d, "raw_jobs"), table(spark, d, "feed_sources")
    names = sorted({r[0] for r in feeds.where("zone_name is not null").select("zone_name").distinct().collect()})
    guessed = estimate_zones(raw.join(feeds.select("source_name", "day_first"), "source_name"), "source_name", "posted_date", "fetched_at", "day_first", names)
    at = raw.where("fetched_at is not null").groupBy("source_name").agg(F.avg(F.unix_seconds("fetched_at")).cast("long").alias("at"))
    both = feeds.select("source_name", F.col("zone_name").alias("declared")).join(guessed.withColumnRenamed("zone_name", "estimated"), "source_name").join(at, "source_name")
    local = lambda zone: F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds("at"), F.col(zone)))
    return both.select("source_name", "declared", "estimated", (local("estimated") - local("declared")).alias("lag_s"))


_SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"
_QUOTED_SQL = r"""@(?:[^@\\]|\\.|@@)*@|''(?:[^''\\]|\\.)*''""".replace("@", chr(34))
_PLAIN_SQL = {True: "[A-Za-z0-9_]+", False: r'''[^,;，；、\t\r\n"''\[\]{}]+'''}


def values_sql(column: str, words: bool) -> str:
    """List of the values of a packed text: quoted spans and runs between delimiters."""
    found = f"regexp_extract_all(coalesce({column}, ''), '{_QUOTED_SQL}|{_PLAIN_SQL[words]}')"
    body = r"""case when t[1:1] in ('"', '''') then replace(replace(replace(substr(t, 2, length(t) - 2), '""', '"'), '\"', '"'), '\''', '''') else t end"""
    trimmed = f"regexp_replace({body}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"
    return f"list_filter(list_transform({found}, lambda t: {trimmed}), lambda v: v <> '')"


_P1 = " union all ".join(
    f"select job_row_id, '{f}' as field_name, unnest(range(1, len(l) + 1))::int as item_no, unnest(l) as item_value from (select job_row_id, {values_sql(f, f != 'block_key')} as l from jobs)"
    for f in JOB_LISTS
)

_DATES = [("raw_jobs", "raw_id", "posted_date"), ("jobs", "job_row_id", "date_posted"), ("jobs", "job_row_id", "valid_through")]
_VALUES = " union all ".join(f"select '{t}' as table_name, {i} as row_id, source_name, '{f}' as field_name, {f} as value from {t}" for t, i, f in _DATES)
_SOURCED = f"select v.*, coalesce(f.zone_name, 'UTC') as zone, coalesce(f.day_first, true) as day_first from ({_VALUES}) v left join feed_sources f using (source_name) where regexp_matches(value, '\\d')"
_P5 = f"select table_name, row_id, field_name, utc_micros from ({instants_sql(_SOURCED)}) where utc_micros is not null"

QUERIES = {"p1_found": p1_found, "p5_found": p5_found, "p5_zones": p5_zones}
SQL = {"p1_found": _P1, "p5_found": _P5}

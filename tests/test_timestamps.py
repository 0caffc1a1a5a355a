from datetime import datetime, timezone

from pyspark.sql import functions as F

from millrace.operators.timestamps import estimate_zones, normalise_instants, resolved_feeds, to_utc_micros


def utc(*a):
    return int(datetime(*a, tzinfo=timezone.utc).timestamp() * 1_000_000)


CASES = [
    (None, "UTC", True, None),
    ("", "UTC", True, None),
    ("MISSING", "UTC", True, None),
    ("2 days ago", "UTC", True, None),
    ("2024-13-45", "UTC", True, None),
    ("2024-02-30", "UTC", True, None),
    ("2024-05-01 25:00", "UTC", True, None),
    ("13/13/2024", "UTC", True, None),
    ("2024-05-01T00:00:00Z", "Asia/Tokyo", True, utc(2024, 5, 1)),
    ("2024-05-01T00:00:00.123456+05:30[Asia/Kolkata]", "UTC", True, utc(2024, 4, 30, 18, 30) + 123456),
    ("2024-05-01T09:00[Asia/Tokyo]", "UTC", True, utc(2024, 5, 1)),
    ("2024-05-01T09:00[No/Where]", "UTC", True, None),
    ("2024-05-01T09:00+29:00", "UTC", True, None),
    ("2024-05-06 18:53:04 +0530", "UTC", True, utc(2024, 5, 6, 13, 23, 4)),
    (" 2024-05-01\n", "Europe/Berlin", True, utc(2024, 4, 30, 22)),
    ("2024/12/14 17:21", "UTC", True, utc(2024, 12, 14, 17, 21)),
    ("20250120T124252Z", "Asia/Tokyo", True, utc(2025, 1, 20, 12, 42, 52)),
    ("20250330", "UTC", True, utc(2025, 3, 30)),
    ("2025-W19-3", "UTC", True, utc(2025, 5, 7)),
    ("2023-W53-1", "UTC", True, None),
    ("2025-305", "UTC", True, utc(2025, 11, 1)),
    ("2025-366", "UTC", True, None),
    ("1746040799", "Asia/Tokyo", True, 1746040799_000000),
    ("1752742159.280", "Asia/Tokyo", True, 1752742159_280000),
    ("1698537925258", "Asia/Tokyo", True, 1698537925_258000),
    ("03/04/2024", "UTC", True, utc(2024, 4, 3)),
    ("03/04/2024", "UTC", False, utc(2024, 3, 4)),
    ("03.04.2024 00:46", "UTC", False, utc(2024, 4, 3, 0, 46)),
    ("02/16/2023 3:13 PM", "UTC", False, utc(2023, 2, 16, 15, 13)),
    ("02/16/2023 12:05 AM", "UTC", False, utc(2023, 2, 16, 0, 5)),
    ("02/16/2023 13:05 PM", "UTC", False, None),
    ("Sun, 06 Oct 2024 17:27:43 GMT", "Asia/Tokyo", True, utc(2024, 10, 6, 17, 27, 43)),
    ("Thu, 19 Dec 2024 15:12:18 -0500", "UTC", True, utc(2024, 12, 19, 20, 12, 18)),
    ("20 Jul 2023 20:31 EST", "UTC", True, utc(2023, 7, 21, 1, 31)),
    ("20 Jul 2023 20:31 QQT", "UTC", True, None),
    ("Dec 26, 2023 9:44 PM", "UTC", True, utc(2023, 12, 26, 21, 44)),
    ("10. März 2024", "UTC", True, utc(2024, 3, 10)),
    ("15 août 2025", "UTC", True, utc(2025, 8, 15)),
    ("7 juin 2024", "UTC", True, utc(2024, 6, 7)),
    ("7 juillet 2024", "UTC", True, utc(2024, 7, 7)),
    ("9. Mai 2024", "UTC", True, utc(2024, 5, 9)),
    ("2024-10-27 02:30:00", "Europe/Berlin", True, utc(2024, 10, 27, 0, 30)),
    ("2024-03-31 02:30:00", "Europe/Berlin", True, utc(2024, 3, 31, 1, 30)),
    ("2024-05-01" + "x" * 100_000, "UTC", True, None),
]


def test_instants(spark):
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(CASES)], "i int, t string, z string, f boolean")
    got = {r.i: r.utc_micros for r in to_utc_micros(df, "t", "z", "f").collect()}
    for i, c in enumerate(CASES):
        assert got[i] == c[3], c[0][:60] if c[0] else c


def test_found_rows_and_session_zone(spark):
    feeds = spark.createDataFrame([("a", "Asia/Tokyo", True)], "source_name string, zone_name string, day_first boolean")
    df = spark.createDataFrame([(1, "a", "2024-05-01 09:00", "x"), (2, None, "2024-05-01", "x"), (3, "zz", "", None)], "raw_id long, source_name string, posted_date string, table_name string")
    spark.conf.set("spark.sql.session.timeZone", "America/Chicago")
    try:
        rows = sorted(tuple(r) for r in normalise_instants(spark, [("raw_jobs", df, "raw_id", ["posted_date"])], feeds).collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert rows == [("raw_jobs", 1, "posted_date", utc(2024, 5, 1)), ("raw_jobs", 2, "posted_date", utc(2024, 5, 1))]


def test_undeclared_zone_is_estimated_from_ingestion(spark):
    # the feed writes Tokyo time and is read a minute later, before and after a change of clocks elsewhere
    raw = spark.sql("""select 'a' source_name, true day_first, date_format(timestamp_micros(t + 9 * 3600000000), 'yyyy-MM-dd HH:mm:ss') posted_date, timestamp_micros(t + 60000000) fetched_at
                       from (select 1700000000000000 + id * 86400000000 t from range(300))""")
    zones = ["UTC", "Asia/Tokyo", "Europe/Berlin", "Australia/Sydney", "America/New_York"]
    assert [tuple(r) for r in estimate_zones(raw, "source_name", "posted_date", "fetched_at", "day_first", zones).collect()] == [("a", "Asia/Tokyo")]
    feeds = spark.createDataFrame([("a", None, True), ("b", "Asia/Tokyo", True)], "source_name string, zone_name string, day_first boolean")
    assert {r.source_name: r.zone_name for r in resolved_feeds(feeds, raw.drop("day_first")).collect()} == {"a": "Asia/Tokyo", "b": "Asia/Tokyo"}
    assert estimate_zones(raw.where(F.lit(False)), "source_name", "posted_date", "fetched_at", "day_first", zones).count() == 0

"""Problem 5: dates and times in many formats, precisions and zones, normalised to one instant in UTC.

A when-chain of built-in expressions cuts each value into parts (year to fraction, half of the day, zone); one
``try_make_timestamp`` per value converts them, so impossible dates and times give null. Local times take the zone
declared for their feed. Feeds that declare none get the zone whose offset history fits their ingestion times best.
"""

from __future__ import annotations

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.session import is_blank, utrim

# Month names (English, German, French; first letters suffice) and zone abbreviations.
MONTHS = {
    1: ("jan",), 2: ("feb", "fév", "fev"), 3: ("mar", "mär", "mae", "mrz"), 4: ("apr", "avr"), 5: ("may", "mai"), 6: ("jun", "juin"),
    7: ("jul", "juil"), 8: ("aug", "aoû", "aou"), 9: ("sep",), 10: ("oct", "okt"), 11: ("nov",), 12: ("dec", "dez", "déc"),
}
ABBREVIATIONS = {
    "Z": "+00:00", "UTC": "+00:00", "GMT": "+00:00", "UT": "+00:00", "WET": "+00:00", "WEST": "+01:00", "BST": "+01:00",
    "CET": "+01:00", "CEST": "+02:00", "EET": "+02:00", "EEST": "+03:00", "MSK": "+03:00", "IST": "+05:30", "JST": "+09:00",
    "AEST": "+10:00", "AEDT": "+11:00", "EST": "-05:00", "EDT": "-04:00", "CST": "-06:00", "CDT": "-05:00",
    "MST": "-07:00", "MDT": "-06:00", "PST": "-08:00", "PDT": "-07:00",
}

_TIME = r"(?:(?:[T,]| +at)? *(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?)?"
_ZONE = r" *(AM|PM|am|pm)? *(Z|[+-]\d{2}:?\d{2}|[A-Z]{2,5})?(?:\[([^\]]+)\])?"
YMD = rf"^(\d{{4}})([-/])(\d{{1,2}})\2(\d{{1,2}}){_TIME}{_ZONE}$"
COMPACT = r"^(\d{4})(\d{2})(\d{2})(?:T(\d{2})(\d{2})(\d{2})?(Z|[+-]\d{2}:?\d{2})?)?$"
WEEK = r"^(\d{4})-?W(\d{2})-?([1-7])$"
ORDINAL = r"^(\d{4})-(\d{3})$"
PAIR = rf"^(\d{{1,2}})([/.])(\d{{1,2}})\2(\d{{4}}){_TIME}{_ZONE}$"
DAY_MONTH = rf"^(?:\p{{L}}+,? +)?(\d{{1,2}})\.? +(\p{{L}}{{3,12}})\.?,? +(\d{{4}}){_TIME}{_ZONE}$"
MONTH_DAY = rf"^(?:\p{{L}}+, +)?(\p{{L}}{{3,12}})\.? +(\d{{1,2}}),? +(\d{{4}}){_TIME}{_ZONE}$"


def zone_ids() -> list[str]:
    """The zone names that the JVM knows; others make a conversion fail."""
    return sorted(SparkContext._active_spark_context._jvm.java.time.ZoneId.getAvailableZoneIds())


def _month(name: Column) -> Column:
    low = F.lower(name)
    out = F.lit(None).cast("int")
    for number, starts in MONTHS.items():
        hit = low.startswith(starts[0])
        for s in starts[1:]:
            hit = hit | low.startswith(s)
        out = F.when(hit, F.lit(number)).otherwise(out)
    return out


def parse_parts(text: Column, day_first: Column) -> Column:
    """Array of year, month, day, hour, minute, second, fraction, half of the day, zone, zone name as text; null if none of the forms fits.

    Parts that a value doesn't state are empty. Each form costs one match and one replacement.
    """

    def cut(pattern: str, order: str) -> Column:
        return F.regexp_replace(text, pattern, order)

    def of_date(d: Column) -> Column:
        return F.concat(F.date_format(d, "yyyy|MM|dd"), F.lit("|||||||"))

    jan4 = F.make_date(F.substring(text, 1, 4).cast("int"), F.lit(1), F.lit(4))
    week_no, day_no = F.regexp_extract(text, WEEK, 2).cast("int"), F.regexp_extract(text, WEEK, 3).cast("int")
    monday = F.date_add(jan4, (week_no - 1) * 7 - F.weekday(jan4))
    # the Thursday of a week lies in the year the week belongs to: week 53 of a short year gives null
    week = F.when((week_no > 0) & (F.year(F.date_add(monday, 3)) == F.year(jan4)), F.date_add(monday, day_no - 1))
    first = F.make_date(F.substring(text, 1, 4).cast("int"), F.lit(1), F.lit(1))
    nth = F.date_add(first, F.substring(text, 6, 3).cast("int") - 1)
    ordinal = F.when(F.year(nth) == F.year(first), nth)
    rest = "|".join(f"${i}" for i in range(5, 12))
    tail = "|".join(f"${i}" for i in range(4, 11))
    day_leads = F.coalesce(day_first, F.lit(True)) | text.contains(".")
    canon = (
        F.when(text.rlike(YMD), cut(YMD, f"$1|$3|$4|{rest}"))
        .when(text.rlike(COMPACT), cut(COMPACT, "$1|$2|$3|$4|$5|$6|||$7|"))
        .when(text.rlike(PAIR), F.when(day_leads, cut(PAIR, f"$4|$3|$1|{rest}")).otherwise(cut(PAIR, f"$4|$1|$3|{rest}")))
        .when(text.rlike(DAY_MONTH), cut(DAY_MONTH, f"$3|$2|$1|{tail}"))
        .when(text.rlike(MONTH_DAY), cut(MONTH_DAY, f"$3|$1|$2|{tail}"))
        .when(text.rlike(WEEK), of_date(week))
        .when(text.rlike(ORDINAL), of_date(ordinal))
    )
    return F.split(canon, r"\|", -1)


def epoch_micros(text: Column) -> Column:
    """Epochs in seconds (10 digits, perhaps with a fraction), milliseconds (13) or microseconds (16); else null."""
    frac = F.substring(F.concat(F.regexp_extract(text, r"^\d{10}\.(\d{1,6})\d*$", 1), F.lit("000000")), 1, 6).cast("long")
    return F.when(text.rlike(r"^\d{10}(?:\.\d+)?$"), F.substring(text, 1, 10).cast("long") * 1_000_000 + F.coalesce(frac, F.lit(0))).when(text.rlike(r"^\d{13}$"), text.cast("long") * 1000).when(text.rlike(r"^\d{16}$"), text.cast("long"))


def parts_to_micros(p: Column, zone: Column) -> Column:
    """Microseconds since 1970 UTC; null for impossible parts. Local times that occur twice are the first, skipped ones are read with the offset before the change."""

    def number(i: int) -> Column:
        return F.coalesce(F.nullif(p[i], F.lit("")), F.lit("0")).cast("int")

    month = F.coalesce(p[1].try_cast("int"), _month(p[1]))
    h = number(3)
    hour = F.when(p[7] == "", h).when(h.between(1, 12), h % 12 + F.when(F.upper(p[7]) == "PM", 12).otherwise(0))
    second = F.concat(F.coalesce(F.nullif(p[5], F.lit("")), F.lit("0")), F.lit("."), F.substring(F.concat(p[6], F.lit("000000")), 1, 6)).cast("decimal(16,6)")
    abbreviations = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    offset = F.when(F.substring(p[8], 2, 2).cast("int") < 18, F.concat(F.substring(p[8], 1, 3), F.lit(":"), F.substring(p[8], -2, 2)))
    # abbreviations, offsets and names of zones that don't exist name no instant, so the value gives none
    own = F.when(p[8].rlike("^[+-]"), offset).when(p[8] != "", F.try_element_at(abbreviations, p[8])).when(p[9] != "", F.when(p[9].isin(*zone_ids()), p[9])).otherwise(zone)
    return F.when(own.isNotNull(), F.unix_micros(F.try_make_timestamp(number(0), month, number(2), hour, number(4), second, own)))


def parsed(df: DataFrame, text: str, day_first: str) -> DataFrame:
    """df with __t, the trimmed text, and __p, its parts.

    The generator keeps the optimizer from copying the parser into each use of a part. The lambda keeps the parser out
    of the generated method of the stage, which would grow past the size that the JVM compiles.
    """
    staged = df.select("*", F.explode(F.transform(F.array(F.col(text)), utrim)).alias("__t"))
    return staged.select("*", F.explode(F.transform(F.array(F.struct(F.col("__t").alias("t"), F.col(day_first).alias("f"))), lambda x: parse_parts(x["t"], x["f"]))).alias("__p"))


def to_utc_micros(df: DataFrame, text: str, zone: str, day_first: str, out: str = "utc_micros") -> DataFrame:
    """df with ``out``: the instant its text column states, or null (blank, relative and impossible values)."""
    given = F.array(F.struct(F.col("__t").alias("t"), F.col("__p").alias("p"), F.col(zone).alias("z")))
    micros = F.transform(given, lambda x: F.coalesce(epoch_micros(x["t"]), parts_to_micros(x["p"], x["z"])))
    return parsed(df, text, day_first).withColumn(out, micros[0]).drop("__t", "__p")


def estimate_zones(df: DataFrame, source: str, text: str, ingested: str, day_first: str, candidates: list[str], default: str = "UTC") -> DataFrame:
    """source, zone_name: for each source the candidate whose offset history breaks fewest constraints with the ingestion times.

    A local timestamp read in a zone is a violation where it lies after its ingestion; among zones without difference
    in violations the one with the smallest total lag wins (a feed is read soon after it is written), then the name.
    Only values with a time of day and no zone of their own testify; sources without such values get ``default``. One
    aggregation over (source, candidate) with partial sums, so a hot source costs no more than another.
    """
    local = parsed(df.select(F.col(source).alias("source_name"), F.col(ingested).alias("__at"), F.col(text).alias("__text"), F.col(day_first).alias("__first")), "__text", "__first")
    local = local.where("__at is not null and __p is not null and __p[8] = '' and __p[9] = '' and __p[3] <> ''")
    tried = local.select("source_name", "__at", "__p", F.explode(F.array(*[F.lit(z) for z in candidates])).alias("zone_name"))
    lag = F.unix_micros("__at") - parts_to_micros(F.col("__p"), F.col("zone_name"))
    per = tried.select("source_name", "zone_name", lag.alias("lag")).groupBy("source_name", "zone_name").agg(F.count_if(F.col("lag") < 0).alias("bad"), F.sum(F.abs("lag").cast("double")).alias("lag"))
    best = per.groupBy("source_name").agg(F.min_by("zone_name", F.struct("bad", "lag", "zone_name")).alias("zone_name"))
    return best.select("source_name", F.coalesce("zone_name", F.lit(default)).alias("zone_name"))


def resolved_feeds(feeds: DataFrame, raw: DataFrame, default: str = "UTC") -> DataFrame:
    """source_name, zone_name, day_first: declared zones, and estimated ones for feeds that declare none."""
    known = feeds.select("source_name", F.when(~is_blank(F.col("zone_name")), F.when(utrim(F.col("zone_name")).isin(*zone_ids()), utrim(F.col("zone_name")))).alias("zone_name"), "day_first").dropDuplicates(["source_name"])
    undeclared = known.where("zone_name is null").select("source_name", "day_first")
    # candidate zones are those of the other feeds, at most as many as the JVM knows; a feed list without gaps costs no pass over raw
    names = sorted({r[0] for r in known.select("zone_name").distinct().collect() if r[0]} | {default})
    if undeclared.isEmpty():
        return known
    guessed = estimate_zones(raw.join(undeclared, "source_name"), "source_name", "posted_date", "fetched_at", "day_first", names, default)
    return known.join(guessed.withColumnRenamed("zone_name", "guess"), "source_name", "left").select("source_name", F.coalesce("zone_name", "guess", F.lit(default)).alias("zone_name"), "day_first")


def normalise_instants(spark: SparkSession, tables: list[tuple[str, DataFrame, str, list[str]]], feeds: DataFrame, default: str = "UTC") -> DataFrame:
    """table_name, row_id, field_name, utc_micros for (name, frame, row id column, date columns) of each table; rows without source take ``default``."""
    out = None
    for name, df, row_id, fields in tables:
        pairs = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields])
        rows = df.select(F.lit(name).alias("table_name"), F.col(row_id).cast("long").alias("row_id"), "source_name", F.inline(pairs)).where(F.col("value").rlike(r"\d"))
        out = rows if out is None else out.unionByName(rows)
    joined = out.join(feeds, "source_name", "left").withColumn("zone_name", F.coalesce("zone_name", F.lit(default)))
    done = to_utc_micros(joined, "value", "zone_name", "day_first")
    return done.where("utc_micros is not null").select("table_name", "row_id", "field_name", "utc_micros")

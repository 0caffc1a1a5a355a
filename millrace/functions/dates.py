"""Dates of postings for readers: calendar date, freshness, expiry, relative ages. Times without a zone count as UTC.

``dated`` parses a column once; the other functions are expressions over its columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millrace.operators.timestamps import _month, epoch_micros, parsed, parts_to_micros
from millrace.session import is_blank

# Words of relative ages with what they count as, and the phrases that cards show, in the order they are looked for.
AGE_WORDS = (("today", "fresh"), ("just now", "fresh"), ("hour", "fresh"), ("day", "fresh"), ("week", "recent"), ("month", "recent"))
AGE_PHRASES = (
    "just now", "today", "1 hour ago", "2 hours ago", "3 hours ago", "1 day ago", "2 days ago", "3 days ago", "1 week ago", "2 weeks ago",
    "active 1 day ago", "active 2 days ago", "day ago", "days ago", "week ago", "weeks ago", "hour ago", "hours ago",
)
DAY = 86_400_000_000


def dated(df: DataFrame, text: str, prefix: str) -> DataFrame:
    """df with <prefix>_micros, the instant that a text column states (null if it states none), and <prefix>_date, its calendar date YYYY-MM-DD in the value's own offset (empty if none)."""
    p, t = F.col("__p"), F.col("__t")
    staged = parsed(df.withColumn("__first", F.lit(True)), text, "__first")
    micros = F.transform(F.array(F.struct(t.alias("t"), p.alias("p"))), lambda x: F.coalesce(epoch_micros(x["t"]), parts_to_micros(x["p"], F.lit("UTC"))))[0]
    staged = staged.withColumn(f"{prefix}_micros", micros)
    own = F.make_date(p[0].cast("int"), F.coalesce(p[1].try_cast("int"), _month(p[1])), p[2].cast("int"))
    of_epoch = F.date_from_unix_date(F.floor(F.col(f"{prefix}_micros") / DAY).cast("int"))
    date = F.when(F.col(f"{prefix}_micros").isNull(), "").otherwise(F.date_format(F.when(p.isNull(), of_epoch).otherwise(own), "yyyy-MM-dd"))
    return staged.withColumn(f"{prefix}_date", date).drop("__p", "__t", "__first")


def freshness(text: Column, micros: Column, as_of: Column) -> Column:
    """fresh, recent, older or stale by age in days at ``as_of`` (microseconds); by the words of a relative age where there is no date; else MISSING."""
    age = (as_of - micros) / DAY
    low, told = F.lower(text), F.lit("MISSING")
    for word, label in reversed(AGE_WORDS):
        told = F.when(low.contains(word), label).otherwise(told)
    by_age = F.when(age <= 1, "fresh").when(age <= 7, "recent").when(age <= 30, "older").otherwise("stale")
    return F.when(is_blank(text), "MISSING").when(micros.isNull(), told).otherwise(by_age)


def expired(micros: Column, as_of: Column) -> Column:
    """Whether a posting's last day lies before ``as_of``; false where none is stated."""
    return F.coalesce(micros < as_of, F.lit(False))


def age_phrase(text: Column) -> Column:
    """The first of the phrases of a relative age that a card's text holds; empty if none."""
    low, out = F.lower(F.coalesce(text, F.lit(""))), F.lit("")
    for phrase in reversed(AGE_PHRASES):
        out = F.when(low.contains(phrase), phrase).otherwise(out)
    return out

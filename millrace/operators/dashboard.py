"""Counts, filters and formats of the cross-run view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def counted(rows: DataFrame, value: Column, name: str, default: str | None = None) -> DataFrame:
    """name, n: how often each value stands, most frequent first, then by value; null and empty ones count as the default, or not at all."""
    v = F.nullif(value, F.lit(""))
    v = v if default is None else F.coalesce(v, F.lit(default))
    return rows.select(v.alias(name)).where(f"`{name}` is not null").groupBy(name).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name)


def source_counts(rows: DataFrame, sources: str = "sources") -> DataFrame:
    """As counted, of each source in an array: a posting counts once for every time it names one."""
    return counted(rows.select(F.explode(sources).alias("__s")), F.col("__s"), "source_name")


def totals(rows: DataFrame, new: Column, status: Column, remote: Column, score: Column) -> DataFrame:
    """total, new_count (not closed), closed_count, remote_count, avg_match (two digits, 0 without scores) in one row."""
    closed = status.eqNullSafe("CLOSED")
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return rows.agg(F.count("*").alias("total"), count(new & ~closed).alias("new_count"), count(closed).alias("closed_count"), count(remote).alias("remote_count"), F.coalesce(F.round(F.avg(score), 2), F.lit(0.0)).alias("avg_match"))


def seen_range(rows: DataFrame, columns: list[str]) -> DataFrame:
    """first_seen, last_seen: over all columns' values that are numbers above or below 0; others are passed over."""
    v = F.explode(F.array(*[F.col(c).try_cast("double") for c in columns]))
    return rows.select(v.alias("v")).where("v <> 0 and not isnan(v)").agg(F.min("v").alias("first_seen"), F.max("v").alias("last_seen"))


def chosen(rows: DataFrame, decision: str = "", status: str = "", source: str = "", remote: bool = False, new: bool = False, text: str = "", texts: list[str] | None = None) -> DataFrame:
    """Rows that pass what is filled in: decision, status, source (own or among ``sources``), remote, new and not closed, a text in one of ``texts``."""
    out = rows
    if decision:
        out = out.where(F.col("decision") == decision)
    if status:
        out = out.where(F.col("authentic_status") == status)
    if source:
        out = out.where((F.col("source_name") == source) | F.coalesce(F.array_contains("sources", source), F.lit(False)))
    if remote:
        out = out.where(F.col("remote"))
    if new:
        out = out.where(F.col("genuinely_new") & ~F.col("authentic_status").eqNullSafe("CLOSED"))
    if text.strip():
        hay = F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in texts or []])
        out = out.where(F.lower(hay).contains(text.strip().lower()))
    return out


def sort_key(column: str, numeric: bool = False) -> Column:
    """Scores as numbers (others as 0), texts without case."""
    c = F.col(column)
    return F.coalesce(c.try_cast("double"), F.lit(0.0)) if numeric else F.lower(F.coalesce(c.cast("string"), F.lit("")))


def score_text(c: Column) -> Column:
    """A number with two decimals; other values as they stand, null as empty."""
    number = c.try_cast("double")
    return F.when(number.isNotNull(), F.replace(F.format_number(number, 2), F.lit(","), F.lit(""))).otherwise(F.coalesce(c.cast("string"), F.lit("")))


def run_time_text(c: Column) -> Column:
    """20240131-235900 as 2024-01-31 23:59; other values as they stand."""
    return F.coalesce(F.date_format(F.try_to_timestamp(F.when(c.rlike(r"^\d{8}-\d{6}$"), c), F.lit("yyyyMMdd-HHmmss")), "yyyy-MM-dd HH:mm"), c)


def ranked(rows: DataFrame) -> list[Column]:
    """Order of the report: decision, match score (confidence where it is 0), fresh ones, oldest first sight, hash."""
    rank = F.when(F.col("decision") == "AUTO_ACCEPT", 3).when(F.col("decision") == "REVIEW", 2).otherwise(0)
    score = F.when(F.coalesce("match_score", F.lit(0.0)) != 0, F.col("match_score")).otherwise(F.coalesce(F.col("confidence_score").cast("double"), F.lit(0.0)))
    fresh = F.col("freshness").eqNullSafe("fresh") if "freshness" in rows.columns else F.lit(False)
    return [rank.desc(), score.desc(), fresh.desc(), F.asc_nulls_last("first_seen_at"), F.asc_nulls_last("job_id_hash")]

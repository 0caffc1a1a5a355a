"""Problem 3: the best record and the best value of each field for every group of duplicate records.

Field-by-field survivorship in one aggregation: for each attribute the maximum of a composite struct (source priority,
timestamp, row id descending, value) over the rows where the attribute isn't blank. Partial maxima are taken before the
shuffle, so a group that holds a third of all rows costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millrace.operators.packed import JOB_LISTS, with_values
from millrace.session import is_blank, utrim

FIELDS = ["location", "description", "apply_url_direct", "valid_through", "experience_needed", "employer_domain"]


def epoch_instant(seconds: Column) -> Column:
    """Seconds since 1970 from an epoch in seconds, milliseconds, microseconds or nanoseconds, told apart by magnitude."""
    size = F.abs(seconds)
    return F.when(size < 1e11, seconds).when(size < 1e14, seconds / 1e3).when(size < 1e17, seconds / 1e6).otherwise(seconds / 1e9)


def canonical_key(c: Column) -> Column:
    """Trimmed and in lower case; null for null and empty ids, which form no group."""
    return F.nullif(F.lower(utrim(c)), F.lit(""))


def _ranked(jobs: DataFrame) -> DataFrame:
    # a struct's maximum puts nulls last and, with the id negated, the smaller id first among equals
    order = F.struct(F.col("source_authority").alias("authority"), epoch_instant(F.col("last_seen_at")).alias("seen"), (-F.col("job_row_id")).alias("minus_id"))
    return jobs.select("*", canonical_key(F.col("canonical_job_id")).alias("canonical_key"), order.alias("o")).where("canonical_key is not null")


def survivors(jobs: DataFrame, fields: list[str] = FIELDS, values: bool = False) -> DataFrame:
    """canonical_key, field_name, job_row_id (and with ``values`` item_value) for each group of two or more rows.

    ``record`` is the first row of the group, a field the first row where it isn't blank, ``seen_sources`` the row with
    the most distinct values, the first of several. A field that is blank in all rows gives no row; ties are broken by
    the smaller job_row_id. Repeated rows count as rows of their group. Empty input gives no rows.
    """
    ranked = _ranked(jobs)

    def entry(c: Column) -> Column:
        return F.struct("o", (c if values else F.lit(None).cast("string")).alias("v"))

    # the values of a row are counted in the row, so one aggregation and one exchange serve all attributes
    ranked = with_values(ranked.withColumn("__t", F.col("seen_sources")), "__t", JOB_LISTS["seen_sources"], "__v")
    distinct = F.size(F.array_distinct("__v"))
    rows = ranked.select(
        "canonical_key", entry(F.lit(None).cast("string")).alias("record"), *[F.when(~is_blank(F.col(f)), entry(F.col(f))).alias(f) for f in fields],
        F.when(distinct > 0, F.struct(distinct.alias("distinct"), entry(F.col("seen_sources")).alias("s"))).alias("sources"),
    )
    best = rows.groupBy("canonical_key").agg(F.count("*").alias("n"), *[F.max(f).alias(f) for f in ("record", *fields)], F.max("sources")["s"].alias("seen_sources"))
    names = ["record", *fields, "seen_sources"]
    out = best.where("n >= 2").select("canonical_key", F.inline(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("s")) for f in names]))).where("s is not null")
    return out.select("canonical_key", "field_name", (-F.col("s.o.minus_id")).alias("job_row_id"), *[F.col("s.v").alias("item_value")] * values)

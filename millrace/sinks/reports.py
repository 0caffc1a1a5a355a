"""Reports: JSON lines, CSV in a fixed order of columns, an HTML page, and the summary of a run.

JSON and CSV are written by the executors. ``ordered`` keeps the order over the files of a folder by range
partitioning; one file is for a report that a reader opens. The page is written row by row from an iterator, so the driver
never holds the report.
"""

from __future__ import annotations

import html
import json

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType

# The columns of the CSV report, in order, and those of the page with their heads.
CSV_COLUMNS = [
    "freshness", "date_posted", "title", "role", "company", "location", "remote", "experience_needed", "salary_if_present", "seniority", "tech_stack_keywords",
    "confidence_score", "authentic_status", "employer_domain", "valid_through", "apply_url_direct", "source_name", "source_url", "first_seen_at", "genuinely_new",
    "seen_sources", "missing_fields", "job_id_hash", "decision", "identity_score", "authenticity_score", "match_score", "matched_via", "possible_duplicate_of",
    "canonical_job_id", "block_key", "evidence", "negative_evidence", "reason",
]
PAGE = [("Fresh", "freshness"), ("Date", "date_posted"), ("Title", "title"), ("Company", "company"), ("Loc", "location"), ("Exp", "experience_needed"), ("Salary", "salary_if_present"), ("Score", "confidence_score"), ("Decision", "decision"), ("Apply", "apply_url_direct"), ("Status", "authentic_status"), ("Domain", "employer_domain"), ("Sources", "seen_sources")]


def csv_rows(rows: DataFrame) -> DataFrame:
    """The columns of the CSV report as text, lists joined with commas; columns that rows don't have are empty."""

    def cell(name: str) -> Column:
        if name not in rows.columns:
            return F.lit("").alias(name)
        c = F.col(f"`{name}`")
        if isinstance(rows.schema[name].dataType, ArrayType):
            c = F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit(""))), ", ")
        return F.coalesce(c.cast("string"), F.lit("")).alias(name)

    return rows.select(*[cell(c) for c in CSV_COLUMNS])


def ordered(rows: DataFrame, order: list[Column], one_file: bool) -> DataFrame:
    return rows.orderBy(*order).coalesce(1) if one_file else rows.orderBy(*order)


def write_csv(rows: DataFrame, path: str, order: list[Column] | None = None, one_file: bool = False) -> None:
    out = ordered(rows, order, one_file) if order else rows
    csv_rows(out).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(rows: DataFrame, path: str, order: list[Column] | None = None, one_file: bool = False) -> None:
    """All columns, null ones too: one object a line."""
    (ordered(rows, order, one_file) if order else rows).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def counts(rows: DataFrame) -> DataFrame:
    """total, authentic, new_count, closed_count of a report in one row."""
    closed = F.col("authentic_status").eqNullSafe("CLOSED")
    return rows.agg(F.count("*").alias("total"), F.count_if(~closed).alias("authentic"), F.count_if(F.coalesce(F.col("genuinely_new"), F.lit(False)) & ~closed).alias("new_count"), F.count_if(closed).alias("closed_count"))


def _cell(row: dict, name: str) -> str:
    v = row.get(name)
    if isinstance(v, (list, tuple)):
        v = ", ".join(map(str, v))
    text = html.escape("" if v is None else str(v))
    if name == "apply_url_direct":
        return f'<a href="{text}" target="_blank">Apply</a>' if text.lower().startswith(("http://", "https://")) else ""
    if name == "title" and row.get("role"):
        return f"{text}<br><small>{html.escape(str(row['role']))}</small>"
    if name == "location" and row.get("remote"):
        return f"{text} (remote)"
    if name == "decision" and row.get("reason"):
        return f"{text}<br><small>{html.escape(str(row['reason'][0]))}</small>"
    return text


def write_page(rows: DataFrame, path: str, title: str, order: list[Column] | None = None) -> None:
    """A page with a table of all rows; closed and new ones carry a class. Every value is escaped; links other than http(s) are left out."""
    n = counts(rows).first()
    out = rows.orderBy(*order) if order else rows
    with open(path, "w", encoding="utf-8") as f:
        f.write(f'<!doctype html>\n<html lang="en"><head><meta charset="utf-8"><title>{html.escape(title)}</title></head><body>\n<h1>{html.escape(title)}</h1>\n')
        f.write(f"<p>{n.total} postings, {n.new_count} new, {n.closed_count} closed.</p>\n<table><thead><tr>{''.join(f'<th>{h}</th>' for h, _ in PAGE)}</tr></thead><tbody>\n")
        for r in out.toLocalIterator():
            row = r.asDict(recursive=True)
            kind = "closed" if row.get("authentic_status") == "CLOSED" else "new" if row.get("genuinely_new") else ""
            f.write(f'<tr class="{kind}">{"".join(f"<td>{_cell(row, c)}</td>" for _, c in PAGE)}</tr>\n')
        f.write("</tbody></table></body></html>\n")


def write_dashboard(rows: DataFrame, runs: DataFrame, stats: dict[str, DataFrame], path: str, title: str) -> None:
    """A page with the counts (each of a bounded number of values), the runs and all rows as data for a browser; no value can end the script."""

    def safe(v) -> str:
        return json.dumps(v, default=str, ensure_ascii=False).replace("</", "<\\/")

    with open(path, "w", encoding="utf-8") as f:
        f.write(f'<!doctype html>\n<html lang="en"><head><meta charset="utf-8"><title>{html.escape(title)}</title></head><body>\n<h1>{html.escape(title)}</h1>\n')
        for name, df in {"runs": runs, **stats}.items():
            f.write(f"<h2>{html.escape(name)}</h2><table><tr>{''.join(f'<th>{html.escape(c)}</th>' for c in df.columns)}</tr>\n")
            for r in df.toLocalIterator():
                f.write("<tr>" + "".join(f"<td>{html.escape('' if v is None else str(v))}</td>" for v in r) + "</tr>\n")
            f.write("</table>\n")
        f.write("<script>const JOBS = [\n")
        for i, r in enumerate(rows.toLocalIterator()):
            f.write((",\n" if i else "") + safe(r.asDict(recursive=True)))
        f.write("\n];</script></body></html>\n")


def run_summary(raw: DataFrame, matched: DataFrame, outcomes: DataFrame, run_ts: str) -> DataFrame:
    """run_ts, total_raw, total_matched, new_count, closed_count and the status of each source, in one row."""
    n = counts(matched).withColumnRenamed("total", "total_matched").drop("authentic")
    statuses = outcomes.agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("source_name", F.coalesce("status", F.lit("")).alias("status"))))).alias("source_statuses"))
    one = raw.agg(F.count("*").alias("total_raw")).withColumn("run_ts", F.lit(run_ts))
    return one.crossJoin(n).crossJoin(statuses).select("run_ts", "total_raw", "total_matched", "new_count", "closed_count", "source_statuses")  # three tables of one row

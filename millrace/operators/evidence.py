"""Signals for and against a posting, their texts, and what a landed probe of its page tells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions.text import company_domain_hint
from millrace.functions.urls import url_domain
from millrace.session import is_blank
from millrace.sources.feeds import is_blocked

# What is said for each signal, what marks a closed page and what a page that asks for a human.
REASONS = {
    "official_ats_source": "official ATS/API source", "official_domain": "apply URL on employer domain", "valid_posting_id": "external posting ID present",
    "active_application": "application is active", "current_posting": "recently posted", "structured_job_posting": "structured job posting data",
    "cross_source_agreement": "seen on multiple sources", "http_gone": "apply URL returns 404/410", "expired_valid_through": "posting expired (validThrough in the past)",
    "closed_state": "job marked closed", "position_filled": "position has been filled", "generic_careers_redirect": "redirected to a generic careers page",
    "employer_domain_mismatch": "apply URL domain does not match employer", "broken_application": "no usable application URL",
    "captcha_required": "application blocked by captcha", "blocked_response": "application blocked (403/anti-bot)",
}
CLOSED_MARKERS = (
    "no longer accepting", "this position has been closed", "job has been closed", "job has expired", "requisition has been closed",
    "this job posting is no longer active", "this requisition", "no longer open", "position has been filled", "we are no longer",
    "this listing has expired", "job is no longer",
)
CAPTCHA_MARKERS = ("captcha", "are you a robot", "verify you are human")


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _listed(marks: list[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in marks]))


def positive_signals(authority: Column, freshness: Column, n_sources: Column, status_code: Column | None = None) -> Column:
    """Names of the signals for a posting (company, employer_domain, posting_id, authentic_status, source_name), in fixed order."""
    hint, code = company_domain_hint(F.col("company")), F.lit(None).cast("int") if status_code is None else status_code
    return _listed(
        [
            ("official_ats_source", authority >= 4), ("official_domain", (hint != "") & F.lower(_text("employer_domain")).contains(hint)), ("valid_posting_id", _text("posting_id") != ""),
            ("active_application", ~F.col("authentic_status").eqNullSafe("CLOSED") & ~F.coalesce(code.isin(404, 410), F.lit(False))),
            ("current_posting", freshness.isin("fresh", "recent")), ("structured_job_posting", F.lower(_text("source_name")) == "google_jobs"), ("cross_source_agreement", n_sources > 1),
        ]
    )


def negative_signals(expired: Column, probe: Column | None = None) -> Column:
    """Names of the signals against a posting (company, employer_domain, authentic_status, apply_url_direct), in fixed order.

    probe: struct of status_code, redirect_to, blocked, closed_marker, position_filled and captcha, as ``verified`` gives it.
    """
    no = F.lit(False)
    get = lambda name, kind: F.lit(None).cast(kind) if probe is None else probe[name]
    true = lambda c: F.coalesce(c, no)
    gone = true(get("status_code", "int").isin(404, 410))
    hint, domain = company_domain_hint(F.col("company")), F.lower(_text("employer_domain"))
    captcha, blocked = true(get("captcha", "boolean")), true(get("blocked", "boolean"))
    return _listed(
        [
            ("http_gone", gone), ("expired_valid_through", true(expired)), ("closed_state", F.col("authentic_status").eqNullSafe("CLOSED") & ~gone),
            ("position_filled", true(get("position_filled", "boolean")) | true(F.lower(get("closed_marker", "string")).contains("position has been filled"))),
            ("generic_careers_redirect", true(F.lower(get("redirect_to", "string")).contains("careers"))), ("employer_domain_mismatch", (hint != "") & (domain != "") & ~domain.contains(hint)),
            ("broken_application", _text("apply_url_direct").isin("", "MISSING")), ("captcha_required", captcha), ("blocked_response", blocked & ~captcha),
        ]
    )


def reason_text(signal: Column) -> Column:
    """What is said for a signal; an unknown one with blanks in the place of underscores."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv]), signal), F.replace(signal, F.lit("_"), F.lit(" ")))


def reasons(positive: Column, negative: Column) -> Column:
    return F.concat(F.transform(positive, reason_text), F.transform(negative, lambda s: F.concat(F.lit("negative: "), reason_text(s))))


def verified(postings: DataFrame, probes: DataFrame, expired: Column) -> DataFrame:
    """postings with authentic_status, apply_url_direct and employer_domain after a look at landed probes, and ``probe``.

    probes: apply_url_direct, status_code, body, final_url; no row for an URL means that it wasn't looked at. CLOSED: no URL,
    expired, unreachable (null status), gone, server error, or a marker of a closed page in the first 8,000 characters.
    Several probes of one URL: the largest status code counts. Scores of confidence are left out.
    """
    one = probes.groupBy("apply_url_direct").agg(F.max(F.struct(F.coalesce("status_code", F.lit(599)).alias("code"), F.substring(F.coalesce("body", F.lit("")), 1, 8000).alias("body"), F.coalesce("final_url", F.lit("")).alias("url"))).alias("__q"))
    q, low = F.col("__q"), F.lower(F.col("__q.body"))
    marker = F.lit("")
    for m in reversed(CLOSED_MARKERS):
        marker = F.when(low.contains(m), m).otherwise(marker)
    unusable, late = is_blank(F.col("apply_url_direct")), F.coalesce(expired, F.lit(False))
    down = q["code"].isin(404, 410) | (q["code"] >= 500)
    blocked = is_blocked(q["code"], q["body"])
    seen = q.isNotNull() & ~unusable & ~late
    open_page = seen & ~down
    closed_page = open_page & ~blocked & (marker != "")
    human = F.lit(False)
    for m in CAPTCHA_MARKERS:
        human = human | low.contains(m)
    probe = F.when(
        seen,
        F.struct(
            q["code"].alias("status_code"), F.nullif(q["url"], F.lit("")).alias("redirect_to"), (open_page & blocked).alias("blocked"), F.when(closed_page, marker).alias("closed_marker"),
            (closed_page & (marker == "position has been filled")).alias("position_filled"), (closed_page & human).alias("captcha"),
        ),
    )
    url = F.when(open_page & (q["url"] != ""), q["url"]).otherwise(F.col("apply_url_direct"))
    out = postings.join(one, "apply_url_direct", "left").withColumns({"probe": probe, "__url": url, "__closed": unusable | late | F.coalesce(seen & down, F.lit(False)) | F.coalesce(closed_page, F.lit(False)), "__open": F.coalesce(open_page, F.lit(False))})
    return out.withColumns(
        {
            "authentic_status": F.when(F.col("__closed"), "CLOSED").otherwise(F.col("authentic_status")), "employer_domain": F.when(F.col("__open"), url_domain(F.col("__url"))).otherwise(F.col("employer_domain")),
            "apply_url_direct": F.col("__url"),
        }
    ).drop("__q", "__url", "__closed", "__open")

"""The final PASS / FAIL / REVIEW rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Domain statuses that fail at once, and matches that tell nothing.
FAILED_STATUSES = (
    "dead",
    "timeout",
    "ssl_error",
    "invalid_domain",
    "not_found",
    "server_error",
    "error",
    "redirects_to_social",
)
UNREADABLE_MATCHES = ("no_text", "error", "skipped")
DECISIONS = ("PASS", "FAIL", "REVIEW")


def decide(
    domain_status: Column, industry_match: Column, matched: Column, negative: Column
) -> Column:
    """``(filter_decision, filter_reason)`` of a row; the first rule that holds decides."""
    status = F.coalesce(domain_status, F.lit("unknown"))
    match = F.coalesce(industry_match, F.lit("unknown"))
    matched, negative = (F.coalesce(c, F.lit("")) for c in (matched, negative))

    def verdict(decision: str, *reason) -> Column:
        text = F.concat(*[r if isinstance(r, Column) else F.lit(r) for r in reason])
        return F.struct(F.lit(decision).alias("filter_decision"), text.alias("filter_reason"))

    return (
        F.when(status.isin(*FAILED_STATUSES), verdict("FAIL", "Domain: ", status))
        .when(match == "parked_domain", verdict("FAIL", "Parked/dead domain"))
        .when(
            match == "negative_match", verdict("FAIL", "Negative keyword match: ", negative)
        )
        .when(match == "no_match", verdict("FAIL", "No industry keyword matches on homepage"))
        .when(match == "match", verdict("PASS", "Keywords: ", matched))
        .when(match == "weak_match", verdict("REVIEW", "Weak match: ", matched))
        .when(
            match.isin(*UNREADABLE_MATCHES),
            verdict("REVIEW", "Could not extract text: ", match),
        )
        .otherwise(verdict("REVIEW", "Unclassified: ", status, "/", match))
    )

"""Layer 1: one verdict per URL from a log of probe answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadsieve.functions.probes import head_outcome, is_live, settle_probe

# The requests a probe may consist of.
ATTEMPTS = {"head": "head_https", "head_http": "head_http", "get": "get"}


def pivot_probes(probe_log: DataFrame) -> DataFrame:
    """``probe_log`` as one row per URL with structs ``head``, ``head_http`` and ``get``.

    Several answers to one request are settled by ``probed_at`` if the log has it
    (latest wins), then by the answer itself (answered before failed), so the
    result does not depend on row order. ``max`` combines on the map side: a URL
    with a third of the log shrinks to one row per task before the shuffle.
    """
    answer = [F.col(c) for c in ("status_code", "final_url", "error_kind", "error_text")]
    order = [F.col("probed_at")] if "probed_at" in probe_log.columns else []
    ranked = F.struct(*order, *answer)
    return probe_log.groupBy("url").agg(
        *[
            F.max(F.when(F.col("attempt") == attempt, ranked)).alias(name)
            for name, attempt in ATTEMPTS.items()
        ]
    )


def with_verdict(df: DataFrame, timeout: int, out: str = "_probe") -> DataFrame:
    """Add the verdict struct next to ``url, head, head_http, get``."""
    head, head_http, get = (F.col(name) for name in ATTEMPTS)
    url = F.col("url")
    return (
        df.withColumn("_outcome", head_outcome(url, head))
        .withColumn(out, settle_probe(url, F.col("_outcome"), head, head_http, get, timeout))
        .drop("_outcome", *ATTEMPTS)
    )


def live_summary(df: DataFrame, status: Column | str = "domain_status") -> DataFrame:
    """Live rows, all rows and the live share in percent (null share for no rows)."""
    status = F.col(status) if isinstance(status, str) else status
    counted = df.agg(F.count_if(is_live(status)).alias("live_rows"), F.count("*").alias("total_rows"))
    return counted.withColumn("live_pct", percent(F.col("live_rows"), F.col("total_rows")))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100)

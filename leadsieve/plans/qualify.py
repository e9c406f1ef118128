"""The whole qualification job."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadsieve.config import SieveConfig, require_keywords
from leadsieve.functions.decide import decide
from leadsieve.functions.probes import is_live
from leadsieve.operators.leads import (
    FACT,
    ROW_ID,
    distinct_urls,
    fill_defaults,
    output_projection,
    unify_headers,
    with_working_columns,
)
from leadsieve.operators.pages import FACT_COLUMNS, of_sites, page_facts
from leadsieve.operators.probes import pivot_probes, with_verdict
from leadsieve.sources.storage import settled

STAGES = ("both", "layer1", "layer2")

# A URL with more leads than this is joined in several slices.
SLICE_ROWS = 1_000_000

# What one hashed URL takes in a broadcast table at most: key, slot and half-empty space.
BROADCAST_ROW_BYTES = 32


def qualify(
    leads: DataFrame,
    probe_log: DataFrame | None = None,
    page_snapshot: DataFrame | None = None,
    config: SieveConfig = SieveConfig(),
    stages: str = "both",
    use_api: bool = False,
    facts: DataFrame | None = None,
    slice_rows: int = SLICE_ROWS,
    describe: bool = True,
) -> DataFrame:
    """Label every lead PASS, FAIL or REVIEW; rows in equal rows out.

    ``leads`` holds any string columns; ``_row_id`` numbers its rows and is added if
    absent. ``stages`` is ``both``, ``layer1`` (probes only) or ``layer2`` (leads bring ``domain_status``).
    ``facts`` may replace ``page_snapshot`` by the stored result of ``page_facts``
    for the same configuration. Without ``describe`` rows are only judged: names, snippets and bundles
    of live sites are not computed. Work is done per distinct URL and joined back; the steps before
    that are settled in the shared folder while this function runs (``scratch_scope`` removes them).
    """
    _check_inputs(leads, probe_log, page_snapshot, facts, config, stages)
    rows = with_working_columns(unify_headers(leads))
    urls = settled(url_verdicts(rows, probe_log, config, stages), "urls")
    size = measure(urls)
    per_url = urls
    if stages != "layer1":
        live = urls.where("live")
        if facts is None:
            facts = page_facts(page_snapshot, config, use_api, sites=live, describe=describe)
        else:
            fits = size.live_urls * BROADCAST_ROW_BYTES <= broadcast_limit(leads)
            facts = of_sites(facts, facts["url"], live, fits)
        # columns of their own, so that fields nobody asks for are never computed
        facts = facts.select("url", *[F.col(c).alias(FACT + c) for c in FACT_COLUMNS])
        per_url = urls.join(facts, "url", "left")
    hot = hot_urls(urls, slice_rows) if size.most_leads > slice_rows else None
    joined = join_back(rows, per_url, hot)
    return decided(joined, stages)


def _check_inputs(leads, probe_log, page_snapshot, facts, config, stages) -> None:
    if stages not in STAGES:
        raise ValueError(f"stages must be one of {STAGES}")
    if stages != "layer1":
        require_keywords(config)
        if page_snapshot is None and facts is None:
            raise ValueError("layer 2 needs page_snapshot or facts")
    if stages == "layer2":
        if "domain_status" not in leads.columns:
            raise ValueError("stages='layer2' needs leads with a domain_status column")
    elif probe_log is None:
        raise ValueError("layer 1 needs probe_log")


def url_verdicts(rows: DataFrame, probe_log, config: SieveConfig, stages: str) -> DataFrame:
    """``url, n_leads, live, _probe``: the distinct URLs and what their probes say."""
    if stages == "layer2":
        live_rows = rows.where(is_live(F.col("domain_status")))
        return distinct_urls(live_rows).withColumn("live", F.lit(True))
    urls = distinct_urls(rows).join(pivot_probes(probe_log), "url", "left")
    return with_verdict(urls, config.request_timeout).withColumn(
        "live", is_live(F.col("_probe")["domain_status"])
    )


class UrlSizes(NamedTuple):
    live_urls: int
    most_leads: int


def measure(urls: DataFrame) -> UrlSizes:
    """Two numbers that decide how the large joins are laid out."""
    row = urls.agg(F.count_if("live"), F.max("n_leads")).first()
    return UrlSizes(row[0], row[1] or 0)


def broadcast_limit(df: DataFrame) -> int:
    """The session's own limit for broadcast tables, in bytes (negative: never)."""
    text = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold").strip().lower()
    units = {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}
    number = text.removesuffix("b") if text[-2:-1].isalpha() else text
    unit = units.get(number[-1], 1)
    return int(number.rstrip("bkmgt")) * unit


def hot_urls(urls: DataFrame, slice_rows: int) -> DataFrame:
    """``_code, _slices``: hashes of the URLs with more than ``slice_rows`` leads.

    There are at most (number of leads / ``slice_rows``) of them, 16 bytes each: some
    megabytes for a million million leads. URLs that share a hash are treated alike.
    """
    return (
        urls.where(F.col("n_leads") > slice_rows)
        .groupBy(F.xxhash64("url").alias("_code"))
        .agg(F.max(F.ceil(F.col("n_leads") / slice_rows)).alias("_slices"))
    )


def join_back(rows: DataFrame, per_url: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Every lead with the ``_probe`` and ``_fact_`` columns of its URL.

    Leads without a URL get a join key of their own, so they spread over all
    partitions instead of meeting in one. Normally the key is the URL, by which
    the other side is partitioned already. Leads of ``hot`` URLs are cut into slices
    by row number, and the one row of such a URL is repeated per slice.
    """
    url, alone = F.col("_url"), F.concat(F.lit("#"), F.col(ROW_ID).cast("string"))
    values = [c for c in per_url.columns if c == "_probe" or c.startswith(FACT)]
    keyed = rows.withColumn("_key", F.coalesce(url, alone))
    right = per_url.withColumnRenamed("url", "_key")
    if hot is None:
        return keyed.join(right.select("_key", *values), "_key", "left").drop("_key")

    def with_slices(df: DataFrame) -> DataFrame:
        df = df.withColumn("_code", F.xxhash64("_key")).join(F.broadcast(hot), "_code", "left")
        return df.withColumn("_slices", F.coalesce("_slices", F.lit(1)))

    keyed = with_slices(keyed).withColumn("_slice", F.pmod(F.xxhash64(ROW_ID), "_slices"))
    repeated = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_slices") - 1))
    right = with_slices(right).select("_key", *values, repeated.alias("_slice"))
    joined = keyed.join(right, ["_key", "_slice"], "left")
    return joined.drop("_key", "_code", "_slices", "_slice")


def _status_columns(stages: str) -> dict[str, Column]:
    if stages == "layer2":
        return {}
    probe, invalid = F.col("_probe"), F.col("_url").isNull()
    return {
        "domain_status": F.when(invalid, "invalid_domain").otherwise(probe["domain_status"]),
        "http_code": probe["http_code"],
        "redirect_url": probe["redirect_url"],
    }


def decided(joined: DataFrame, stages: str) -> DataFrame:
    """Fill the output columns of joined rows and apply the decision rules."""
    df = joined.withColumns(_status_columns(stages))
    for name in ("http_code", "redirect_url"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("string"))
    df = fill_defaults(df, stages)
    fields = ("domain_status", "industry_match", "matched_keywords", "negative_keywords")
    df = df.withColumn("_verdict", decide(*[F.col(c) for c in fields]))
    df = df.withColumns(
        {name: F.col("_verdict")[name] for name in ("filter_decision", "filter_reason")}
    )
    return output_projection(df, keep_row_id=True)

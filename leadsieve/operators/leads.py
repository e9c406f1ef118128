"""Leads: header spellings, working columns, distinct URLs, output columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadsieve.functions.domains import domain_value, with_normalized_url
from leadsieve.functions.probes import is_live
from leadsieve.functions.text import nz
from leadsieve.operators.pages import FACT_COLUMNS

# Header spellings, first hit wins.
DOMAIN_HEADERS = ("domain", "website", "Domain", "Website")
NAME_HEADERS = ("company_name", "Company Name", "CompanyName")

# Columns written after the input's own, in this order.
OUTPUT_COLUMNS = (
    "domain_status",
    "http_code",
    "redirect_url",
    "industry_match",
    "matched_keywords",
    "negative_keywords",
    "resolved_name",
    "name_source",
    "pages_scraped",
    "scraped_text",
    "homepage_snippet",
    "filter_decision",
    "filter_reason",
)
# Computed, never written.
UNWRITTEN_COLUMNS = ("is_parked", "error")

# Beginning of the working columns that hold the fields of a lead's site.
FACT = "_fact_"

# Number of a lead within its input; like all names with ``_`` it is never written.
ROW_ID = "_row_id"


def exact(columns, names) -> str | None:
    """The first of ``names`` that is a column, letter case included."""
    return next((n for n in names if n in columns), None)


def unify_headers(df: DataFrame) -> DataFrame:
    """Provide ``domain`` and ``company_name`` under whatever header they came.

    The header decides, not the values; the found column is kept as well.
    """
    case_sensitive = df.sparkSession.conf.get("spark.sql.caseSensitive") == "true"
    written = (*OUTPUT_COLUMNS, *UNWRITTEN_COLUMNS)
    if not case_sensitive:
        _reject_hidden(df.columns, written, ())
    for names in (DOMAIN_HEADERS, NAME_HEADERS):
        found = exact(df.columns, names)
        if not found or found == names[0]:
            continue
        if not case_sensitive:
            _reject_hidden(df.columns, names[:1], (found,))
        if found.lower() == names[0] and not case_sensitive:
            # Such a session cannot hold both spellings.
            df = df.withColumnRenamed(found, names[0])
        else:
            df = df.withColumn(names[0], df[quoted(found)])
    return df


def _reject_hidden(columns, new_names, but) -> None:
    """Stop where a new column would take the place of one that differs from it in case alone."""
    for name in new_names:
        hidden = [c for c in columns if c.lower() == name and c != name and c not in but]
        if hidden:
            raise ValueError(f"{hidden[0]!r} and {name!r} need spark.sql.caseSensitive=true")


def quoted(name: str) -> str:
    """A column name as Spark expressions take it, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def with_working_columns(leads: DataFrame) -> DataFrame:
    """Add ``_url`` (normalised, nullable), ``_raw_name`` (never null) and a row number."""
    if ROW_ID not in leads.columns:
        leads = leads.withColumn(ROW_ID, F.monotonically_increasing_id())
    names = [nz(F.col(quoted(n))) for n in NAME_HEADERS[:2] if n in leads.columns]
    df = leads.withColumn("_raw_name", F.coalesce(*names, F.lit("")))
    return with_normalized_url(df, domain_value(leads.columns), "_url")


def distinct_urls(leads: DataFrame) -> DataFrame:
    """``url, n_leads``: many leads share a URL, and each URL is worked on once.

    Leads without a URL form a group of count 0, dropped after counting. A filter on
    ``_url`` itself would be pushed below the projections that compute it, and with
    it a copy of the whole computation for every place the host is mentioned.
    """
    counted = leads.groupBy(F.col("_url").alias("url")).agg(F.count("_url").alias("n_leads"))
    return counted.where(F.col("n_leads") > 0)


def original_columns(columns) -> list[str]:
    """Input columns that are passed through."""
    computed = (*OUTPUT_COLUMNS, *UNWRITTEN_COLUMNS)
    return [c for c in columns if not c.startswith("_") and c not in computed]


def output_projection(df: DataFrame, keep_row_id: bool = False) -> DataFrame:
    """The written columns: input columns in input order, then the computed ones."""
    head = [ROW_ID] if keep_row_id and ROW_ID in df.columns else []
    names = [*head, *original_columns(df.columns), *OUTPUT_COLUMNS]
    return df.select(*[F.col(quoted(n)) for n in names])


def layer2_fields(live: Column, facts, failure: Column, existing) -> dict[str, Column]:
    """The eight layer-2 fields of a row, whatever became of it.

    ``facts`` has the fields of the row's site by name, ``failure`` the message of a row
    whose processing failed. A live row without pages counts as parked. A row that
    was not looked at keeps what an earlier run left in ``existing`` columns.
    """
    raw = F.col("_raw_name")
    no_url = live & F.col("_url").isNull()
    failed = live & failure.isNotNull()

    def earlier(name: str, default) -> Column:
        if name in existing:
            return F.coalesce(F.col(f"`{name}`"), F.lit(""))
        return default if isinstance(default, Column) else F.lit(default)

    untouched = "industry_match" in existing

    def idle(name: str, default) -> Column:
        if untouched:
            return earlier(name, "")
        if name in ("matched_keywords", "homepage_snippet"):
            return F.lit(default)
        return earlier(name, default)

    def field(name, error, skipped, missing, idle_default):
        return (
            F.when(failed, error)
            .when(no_url, skipped)
            .when(live, F.coalesce(facts[name], missing))
            .otherwise(idle(name, idle_default))
        )

    empty = F.lit("")
    return {
        "industry_match": field(
            "industry_match", F.lit("error"), F.lit("skipped"), F.lit("parked_domain"), "domain_dead"
        ),
        "matched_keywords": field("matched_keywords", empty, empty, empty, ""),
        "negative_keywords": field(
            "negative_keywords", *[earlier("negative_keywords", "")] * 3, ""
        ),
        "homepage_snippet": field("homepage_snippet", F.left(failure, F.lit(200)), empty, empty, ""),
        "resolved_name": field("resolved_name", earlier("resolved_name", ""), raw, raw, raw),
        "name_source": field(
            "name_source",
            earlier("name_source", ""),
            F.lit("skipped"),
            F.lit("parked_domain"),
            "domain_dead",
        ),
        "scraped_text": field("scraped_text", earlier("scraped_text", ""), empty, empty, ""),
        "pages_scraped": field("pages_scraped", earlier("pages_scraped", ""), empty, empty, ""),
    }


def not_run_fields(existing) -> dict[str, Column]:
    """The layer-2 fields when only layer 1 runs; columns already there are kept."""
    fixed = {
        "industry_match": F.lit("not_run"),
        "name_source": F.lit("not_run"),
        "resolved_name": F.col("_raw_name"),
    }
    return {
        name: F.coalesce(F.col(f"`{name}`"), F.lit(""))
        if name in existing
        else fixed.get(name, F.lit(""))
        for name in FACT_COLUMNS
    }


def fill_defaults(df: DataFrame, stages: str) -> DataFrame:
    """Complete the layer-2 fields of every row.

    Takes ``domain_status``, ``_url``, ``_raw_name`` and, unless only layer 1 ran,
    a struct ``_facts`` or columns ``_fact_...`` and optionally a message ``_failure``. A live site that
    turns out parked changes its ``domain_status``.
    """
    existing = [c for c in df.columns if c in FACT_COLUMNS]
    if stages == "layer1":
        return df.withColumns(not_run_fields(existing))
    live = is_live(F.col("domain_status"))
    failure = F.col("_failure") if "_failure" in df.columns else F.lit(None).cast("string")
    packed = "_facts" in df.columns
    facts = F.col("_facts") if packed else {c: F.col(FACT + c) for c in FACT_COLUMNS}
    fields = layer2_fields(live, facts, failure, existing)
    parked = live & (fields["industry_match"] == "parked_domain")
    return df.withColumns(
        {**fields, "domain_status": F.when(parked, "parked").otherwise(F.col("domain_status"))}
    )

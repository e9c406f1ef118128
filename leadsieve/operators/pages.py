"""Layer 2: everything a site's stored pages say, one row per site.

The snapshot is the one truly large table. What of it counts is settled before any page is parsed:

1. A narrow scan (address, origin, time) finds the latest capture of every page that can
   count, one row per site (``captures``).
2. Homepages: a bitmap of these captures lets the wide scan parse them and little else; every
   homepage is reduced to a few kilobytes where it is read (text, match, name).
3. Sub-pages: the same for the sub-pages of sites that matched; no others are parsed.

Raw HTML is in no shuffle. Captures of one time are settled by their content: a rank of fixed width
(time and hash of the content) is maximised by hash aggregates, and the winners' fields are
fetched by it. Grouping starts before the shuffle, so a site with many captures
shrinks to one row per task.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadsieve.config import SieveConfig, candidate_paths
from leadsieve.functions.keywords import listed, with_keyword_match
from leadsieve.functions.names import with_site_name
from leadsieve.functions.pages import (
    BUNDLE_SUBPAGE,
    MIN_SUBPAGE_TEXT,
    homepage_part,
    is_parked_text,
    page_url,
    subpage_part,
    text_bundle,
)
from leadsieve.functions.text import (
    SHORT_SNIPPET,
    html_to_text,
    left,
    nz,
    snippet,
    strip,
)
from leadsieve.operators.membership import among, members
from leadsieve.sources.storage import settled

FACT_COLUMNS = (
    "industry_match",
    "matched_keywords",
    "negative_keywords",
    "homepage_snippet",
    "resolved_name",
    "name_source",
    "scraped_text",
    "pages_scraped",
)


# The fields that a decision rests on.
DECIDING_COLUMNS = ("industry_match", "matched_keywords", "negative_keywords")

# Numbers of the pages that count: homepage by origin, then the candidate sub-pages.
HOME_DIRECT, HOME_API, FIRST_SUBPAGE = 0, 1, 2

# A capture without time is older than any other.
_NO_TIME = -(1 << 63)


def site_of(url: Column) -> Column:
    """Site part of a snapshot URL: everything before the path."""
    return F.substring_index(url, "/", 3)


def path_of(url: Column) -> Column:
    """What follows the site part; empty for a homepage, with or without its slash."""
    rest = F.substr(url, F.length(site_of(url)) + 1)
    return F.when(rest == "/", "").otherwise(rest)


def suffixes(paths) -> dict[str, Column]:
    """What a page of each candidate path has behind the site part of its URL."""
    return {"/" + p.lstrip("/"): page_url(F.lit(""), F.lit(p)) for p in paths}


def wanted_pages(snapshot: DataFrame, paths, use_api: bool) -> DataFrame:
    """Rows that can be a homepage or a candidate sub-page, by URL and origin alone.

    With the scraping service in use a homepage may also come from a direct fetch,
    a sub-page may not; without it only direct fetches count.
    """
    rest, via = path_of(F.col("url")), F.col("fetch_via")
    home, sub = rest == "", rest.isin(*suffixes(paths))
    if use_api:
        wanted = ((via == "api") & (home | sub)) | ((via == "direct") & home)
    else:
        wanted = (via == "direct") & (home | sub)
    return snapshot.where(wanted)


def page_number(paths) -> Column:
    """Which page of its site a wanted row is."""
    path = path_of(F.col("url"))
    number = F.when(path == "", F.when(F.col("fetch_via") == "api", HOME_API).otherwise(HOME_DIRECT))
    for i, suffix in enumerate(suffixes(paths), start=FIRST_SUBPAGE):
        number = number.when(path == suffix, i)
    return number


def subpage_numbers(paths) -> range:
    return range(FIRST_SUBPAGE, FIRST_SUBPAGE + len(suffixes(paths)))


def taken_at() -> Column:
    return F.coalesce(F.unix_micros(F.col("captured_at").cast("timestamp")), F.lit(_NO_TIME))


def latest(page: int) -> str:
    """Column of ``captures`` with the time of a page's latest capture."""
    return f"page_{page}"


def of_sites(table: DataFrame, site: Column, urls: DataFrame, fits: bool) -> DataFrame:
    """Keep rows of ``table`` whose ``site`` is among ``urls`` (column ``url``), and few others.

    Only an eight-byte hash per URL is broadcast, and only if ``fits``, the outcome of
    a size check, allows it. A site that shares its hash with a wanted one passes too;
    the join on the URL itself, which follows in any case, drops it. URLs too many to
    broadcast are not joined here, as that would shuffle raw HTML: all pages are
    reduced first and joined afterwards.
    """
    if not fits:
        return table
    codes = urls.select(F.xxhash64("url").alias("_code")).distinct()
    return table.join(F.broadcast(codes), F.xxhash64(site) == F.col("_code"), "left_semi")


def with_page_text(df: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """Add ``_page`` (the page) and its whole text, of answers with status 200."""
    page = F.when(F.col("status_code") == 200, F.col(html))
    return (
        df.withColumn("_page", page)
        .withColumn(out, html_to_text(F.col("_page")))
        .withColumn(out, F.when(F.col(out) != "", F.col(out)))
    )


def captures(snapshot: DataFrame, paths, use_api: bool, sites: DataFrame | None = None) -> DataFrame:
    """``site`` and per page the time of its latest capture, null if there is none.

    Reads addresses, origins and times only. ``sites`` (column ``url``) keeps those sites alone.
    """
    numbers = (HOME_DIRECT, HOME_API, *subpage_numbers(paths))
    rows = wanted_pages(snapshot.select("url", "fetch_via", "captured_at"), paths, use_api).select(
        site_of(F.col("url")).alias("site"), page_number(paths).alias("page"), taken_at().alias("taken")
    )
    found = rows.groupBy("site").agg(
        *[F.max(F.when(F.col("page") == n, F.col("taken"))).alias(latest(n)) for n in numbers]
    )
    if sites is not None:
        found = found.join(sites.select(F.col("url").alias("site")).distinct(), "site", "left_semi")
    return found


def capture_key(site: Column, page: Column, taken: Column) -> Column:
    return F.xxhash64(site, page.cast("int"), taken)


def chosen_pages(snapshot: DataFrame, latest_of: DataFrame, pages: Iterable[int], paths, use_api: bool) -> DataFrame:
    """Rows of ``snapshot`` that are the latest captures of these ``pages``, and few others.

    Adds ``site``, ``page`` and ``rank``, a number of fixed width that orders captures by time,
    and within one time by content. ``latest_of`` has the columns of ``captures``.
    """
    each = [F.struct(F.lit(n).alias("page"), F.col(latest(n)).alias("taken")) for n in pages]
    keys = latest_of.select("site", F.inline(F.array(*each))).where("taken IS NOT NULL")
    wanted = members(keys.select(capture_key(F.col("site"), F.col("page"), F.col("taken"))))
    rows = wanted_pages(snapshot, paths, use_api).select(
        site_of(F.col("url")).alias("site"),
        page_number(paths).alias("page"),
        taken_at().alias("taken"),
        "status_code",
        "html",
    )
    rows = rows.where(F.col("page").isin(*pages))
    rows = among(rows, capture_key(F.col("site"), F.col("page"), F.col("taken")), wanted)
    content = F.xxhash64("status_code", "html").bitwiseAND(F.lit((1 << 62) - 1)).cast("decimal(19,0)")
    rank = F.col("taken").cast("decimal(19,0)") * F.lit(1 << 62).cast("decimal(19,0)") + content
    return rows.withColumn("rank", rank.cast("decimal(38,0)")).drop("taken")


def best_by_rank(rows: DataFrame, pages: Iterable[int], value: Column) -> DataFrame:
    """Per ``site`` the ``value`` of every page's row with the highest rank, in columns ``page_<n>``.

    ``rows`` is a settled table with ``site``, ``page`` and ``rank``. The highest ranks are a hash aggregate
    over these three. Rows that have them are one per page, or several that are equal, which a set makes one
    before they are sent to their site: captures of one page spread by rank, however many there are.
    """
    highest = rows.groupBy("site", "page").agg(F.max("rank").alias("rank"))
    best = rows.join(highest.hint("shuffle_hash"), ["site", "page", "rank"])
    found = best.groupBy("site").agg(F.collect_set(F.struct("page", value.alias("value"))).alias("found"))

    def of_page(n: int) -> Column:
        mine = F.filter("found", lambda p: p["page"] == n)
        return F.get(mine, F.lit(0))["value"].alias(latest(n))

    return found.select("site", *[of_page(n) for n in pages])


def reduce_homepages(pages: DataFrame, cfg: SieveConfig, describe: bool) -> DataFrame:
    """Homepages as ``site, page, rank, verdict, details``; no HTML left.

    Everything heavy is a projection over the scan. ``details`` is null unless ``describe``.
    """
    df = with_page_text(pages).withColumn("_lower", F.lower("text")).drop("html", "status_code")
    df = with_keyword_match(df, "text", "_lower", cfg)
    if describe:
        df = with_site_name(df, "_page", "site_name", "name_source")
        details = F.struct(
            snippet(F.col("text")).alias("snippet"),
            F.col("site_name"),
            F.col("name_source"),
            homepage_part(F.col("text")).alias("part"),
        )
    else:
        details = F.lit(None).cast("struct<snippet:string,site_name:string,name_source:string,part:string>")
    verdict = F.struct(
        F.col("text").isNotNull().alias("has_text"),
        is_parked_text(F.col("text"), F.col("_lower")).alias("parked"),
        F.col("match_result"),
        listed(F.col("matched")).alias("matched"),
        listed(F.col("negatives")).alias("negatives"),
    )
    return df.select("site", "page", "rank", verdict.alias("verdict"), details.alias("details"))


def reduce_subpages(pages: DataFrame) -> DataFrame:
    """Sub-pages as ``site, page, rank, text``: what the bundle takes of them, null if too short."""
    text = F.when(F.length(strip(F.col("text"))) > MIN_SUBPAGE_TEXT, left(F.col("text"), BUNDLE_SUBPAGE))
    return with_page_text(pages).select("site", "page", "rank", text.alias("text"))


def homepage_facts(snapshot: DataFrame, latest_of: DataFrame, cfg: SieveConfig, use_api: bool, describe: bool) -> DataFrame:
    """``site, verdict, details`` of every site with a homepage: service before direct fetch if it has text."""
    pages = (HOME_DIRECT, HOME_API) if use_api else (HOME_DIRECT,)
    chosen = chosen_pages(snapshot, latest_of, pages, (), use_api)
    reduced = settled(reduce_homepages(chosen, cfg, describe), "homepages")
    best = best_by_rank(reduced, pages, F.struct("verdict", "details"))
    home = F.col(latest(HOME_DIRECT))
    if use_api:
        served = F.col(latest(HOME_API))
        home = F.when(served["verdict"]["has_text"], served).otherwise(home)
    return best.select("site", home.alias("home")).select("site", "home.verdict", "home.details")


def is_followed(verdict: Column) -> Column:
    """Whether the sub-pages of a site count."""
    return verdict["match_result"].isin("match", "weak_match") & ~verdict["parked"]


def subpage_texts(snapshot: DataFrame, latest_of: DataFrame, homes: DataFrame, paths, use_api: bool) -> DataFrame:
    """``site`` and the texts of its candidate sub-pages, for the sites that are followed."""
    pages = subpage_numbers(paths)
    followed = latest_of.join(homes.where(is_followed(F.col("verdict"))).select("site"), "site", "left_semi")
    chosen = chosen_pages(snapshot, followed, pages, paths, use_api)
    return best_by_rank(settled(reduce_subpages(chosen), "subpages"), pages, F.col("text"))


def page_facts(
    snapshot: DataFrame,
    cfg: SieveConfig,
    use_api: bool = False,
    extra_paths=(),
    sites: DataFrame | None = None,
    describe: bool = True,
) -> DataFrame:
    """One row per site: ``url`` and the layer-2 fields its pages give.

    The latest capture of a page counts, even if it failed. ``resolved_name`` stays
    null where only the lead itself can name the company. ``sites`` (column ``url``) restricts the
    sites that are looked at. Without ``describe`` only what decides about a site is
    computed: match and keywords; names, snippets and bundles are null.

    Steps are settled in the shared folder while this function runs; see the module.
    """
    paths = candidate_paths(cfg, tuple(extra_paths))
    latest_of = settled(captures(snapshot, paths, use_api, sites), "captures")
    homes = settled(homepage_facts(snapshot, latest_of, cfg, use_api, describe), "sites")
    found = latest_of.select("site").join(homes, "site", "left")
    if not describe:
        described = [c for c in FACT_COLUMNS if c not in DECIDING_COLUMNS]
        return _site_fields(found, []).withColumns({c: F.lit(None).cast("string") for c in described})
    if not suffixes(paths):
        return _site_fields(found, [])
    texts = subpage_texts(snapshot, latest_of, homes, paths, use_api)
    found = found.join(texts, "site", "left")
    number = dict(zip(suffixes(paths), subpage_numbers(paths), strict=True))
    return _site_fields(found, [(p, F.col(latest(number["/" + p.lstrip("/")]))) for p in paths])


def _site_fields(sites: DataFrame, subpages) -> DataFrame:
    """Row-level fields of a site from what its homepage says and its sub-page texts."""
    h, verdict = F.col("details"), F.col("verdict")
    parked = F.coalesce(verdict["parked"], F.lit(True))
    parts = [subpage_part(F.lit(p), t) for p, t in subpages]
    names = [F.when(t.isNotNull(), F.lit(p)) for p, t in subpages]

    def unless_parked(value: Column) -> Column:
        return F.when(parked, F.lit("")).otherwise(value)

    return sites.select(
        F.col("site").alias("url"),
        F.when(parked, "parked_domain").otherwise(verdict["match_result"]).alias("industry_match"),
        unless_parked(verdict["matched"]).alias("matched_keywords"),
        F.when(~parked, verdict["negatives"]).alias("negative_keywords"),
        F.when(parked, snippet(h["snippet"], SHORT_SNIPPET))
        .otherwise(h["snippet"])
        .alias("homepage_snippet"),
        F.when(~parked, nz(h["site_name"])).alias("resolved_name"),
        F.when(parked, "parked_domain").otherwise(h["name_source"]).alias("name_source"),
        unless_parked(text_bundle(h["part"], *parts)).alias("scraped_text"),
        unless_parked(F.concat_ws(";", F.lit("homepage"), *names)).alias("pages_scraped"),
    )


def homepage_source(snapshot: DataFrame, use_api: bool = False) -> DataFrame:
    """Text of every homepage: latest capture, service before direct fetch.

    Only the latest captures are turned into text, before anything is grouped.
    """
    pages = (HOME_DIRECT, HOME_API) if use_api else (HOME_DIRECT,)
    latest_of = settled(captures(snapshot, (), use_api), "captures")
    chosen = with_page_text(chosen_pages(snapshot, latest_of, pages, (), use_api))
    best = best_by_rank(settled(chosen.select("site", "page", "rank", "text"), "texts"), pages, F.col("text"))
    direct, api = F.col(latest(HOME_DIRECT)), F.col(latest(HOME_API)) if use_api else F.lit(None).cast("string")
    origin = F.when(api.isNotNull(), "api").when(direct.isNotNull(), "direct")
    return best.select(F.col("site").alias("url"), F.coalesce(api, direct).alias("text"), origin.alias("text_via"))

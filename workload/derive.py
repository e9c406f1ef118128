"""Leads, probe log and page snapshot derived from the tables ``pages`` and ``documents``.

Every page and every document is one stored web page and one lead. Four of them in
a row form a site: the first is its homepage, the others are sub-pages. What varies
(spelling of the domain, outcome of the probes, markup) follows from the number of the
row or of the site; no row is left out. ``workload/sql.py`` states the same in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadsieve.config import SieveConfig

KEYWORDS = {
    "primary": ["anth", "wher"],
    "secondary": ["tion", "the ", "und "],
    "negative": ["zzneg"],
}
CONFIG = SieveConfig.from_mapping({"industry_keywords": KEYWORDS})

SLOT_PATHS = ("", "/services", "/about", "/about-us")

# What the homepage of site k gets in front of its HTML, by k modulo 7.
MARKUP = (
    "",
    '<meta property="og:site_name" content="ACME WIDGETS, L.L.C.">',
    "<META content='Bob&amp;Sons Septic Inc.' name=x property='og:site_name'>",
    '<title>Home</title><meta property="og:title" content="blue RIVER: pumping">',
    '<title> welcome | home </title><script>{"name" : "river valley pumping co."}</script>',
    "<title>HVAC PROS OF THE WEST, INC. | Home</title>",
    '<title>Index</title><meta content="us rv co-op, ltd." property="og:title">',
)
PARKED_MARKUP = "<p>This Domain is FOR SALE</p>"
NEGATIVE_MARKUP = "<b>zzneg</b>"
OLD_MARKUP = "<title>Old name</title><p>anth wher zzneg</p>"

# Answers per probe case: case, attempt, status, final address, kind and text of the error.
PROBE_CASES = (
    (0, "head_https", 200, "same", None, None),
    (1, "head_https", 200, "www", None, None),
    (2, "head_https", 200, "other", None, None),
    (3, "head_https", 204, "same", None, None),
    (4, "head_https", 301, "same", None, None),
    (5, "head_https", 403, "same", None, None),
    (5, "get", 200, "page", None, None),
    (6, "head_https", 403, "other", None, None),
    (6, "get", 403, "page", None, None),
    (7, "head_https", 404, "same", None, None),
    (8, "head_https", 503, "same", None, None),
    (9, "head_https", None, None, "ssl", "bad certificate"),
    (9, "head_http", 200, "other", None, None),
    (10, "head_https", None, None, "ssl", "bad certificate"),
    (10, "head_http", None, None, "connect", "refused"),
    (10, "get", 404, "page", None, None),
    (11, "head_https", None, None, "connect", "refused"),
    (11, "get", None, None, "connect", "refused"),
    (12, "head_https", None, None, "connect_timeout", "slow"),
    (12, "get", 200, "page", None, None),
    (13, "head_https", None, None, "read_timeout", "slow"),
    (13, "get", 500, "page", None, None),
    (14, "head_https", 403, "social", None, None),
    (14, "get", 200, "page", None, None),
    (15, "head_https", None, None, "other", "too many redirects"),
    (15, "get", 302, "page", None, None),
    (17, "head_https", None, None, "ssl", "bad certificate"),
    (17, "head_http", None, None, "connect", "refused"),
    (17, "get", 200, "page", None, None),
    (18, "head_https", 405, "same", None, None),
    (18, "get", None, None, "other", "reset"),
    (19, "head_https", 429, "same", None, None),
)
PROBE_KINDS = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give all cores a share of a table that comes in fewer splits than there are cores.

    The test tables are single row groups. A table of many splits, as any large one is,
    stays where it is: ``df`` holds nothing but scans, so counting its splits runs nothing.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def text_of(template: str, **columns: Column) -> Column:
    """``template`` with columns in place of ``{name}``."""
    parts, rest = [], template
    while "{" in rest:
        before, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        parts += [F.lit(before), columns[name].cast("string")]
    return F.concat(*parts, F.lit(rest))


def choose(number: Column, values) -> Column:
    """The value whose place in ``values`` is ``number`` modulo their count."""
    place = F.pmod(number, F.lit(len(values)))
    out = F.when(place == 0, values[0])
    for i, value in enumerate(values[1:], start=1):
        out = out.when(place == i, value)
    return out


def crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``row_id, id, site_no, slot, host, html``: pages and documents as stored web pages."""
    return spread(_crawl(spark, sf_dir), "row_id")


def crawl_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows without HTML."""
    return _crawl(spark, sf_dir).drop("html")


def _crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, documents = (table(spark, sf_dir, n) for n in ("pages", "documents"))

    def sites(df: DataFrame, key: str, row_id: Column, host: str, html: Column) -> DataFrame:
        number = F.expr(f"{key} div 4")
        return df.select(
            row_id.alias("row_id"),
            F.col(key).alias("id"),
            number.alias("site_no"),
            (F.col(key) % 4).cast("int").alias("slot"),
            text_of(host, n=number).alias("host"),
            html.alias("html"),
        )

    body = text_of(
        "<html><head><title>{lang} {source} Co-op | Home</title></head>"
        "<body><p>{text}</p></body></html>",
        lang=F.col("lang"),
        source=F.col("source"),
        text=F.col("text"),
    )
    first = sites(pages, "page_id", F.col("page_id") * 2, "p{n}.example.org", F.col("html"))
    second = sites(documents, "doc_id", F.col("doc_id") * 2 + 1, "d{n}.example.net", body)
    return first.unionAll(second)


def marked_html() -> Column:
    """HTML of a stored page with the markup its site is given."""
    k = F.col("site_no")
    home = F.concat(
        choose(k, [F.lit(m) for m in MARKUP]),
        F.when(k % 11 == 5, PARKED_MARKUP).otherwise(""),
        F.when(k % 17 == 0, NEGATIVE_MARKUP).otherwise(""),
        F.col("html"),
    )
    return F.when(F.col("slot") == 0, home).otherwise(F.col("html"))


def leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One lead per stored page, its domain spelled in ten ways."""
    rows = crawl_rows(spark, sf_dir)
    host, r = F.col("host"), F.col("row_id")
    plain = text_of("http://{h}/p/{r}?utm_source=feed", h=host, r=r)
    spellings = [
        F.lit(""),
        text_of("lead{r}", r=r),
        text_of("https://facebook.com/lead{r}", r=r),
        text_of("//www.{h}", h=host),
        text_of(" HTTPS://WWW.{h}/a?b#c ", h=F.upper(host)),
        F.lit(None).cast("string"),
        host,
        plain,
        plain,
        plain,
    ]
    return rows.select(
        "row_id",
        choose(
            F.col("id"),
            [F.lit("")] + [text_of(t, r=r) for t in ("Company {r} LLC", "ACME {r}", "co {r} inc")],
        ).alias("company_name"),
        choose(F.col("id"), spellings).alias("domain"),
        F.when(F.col("id") % 10 == 0, text_of("https://www.{h}/x", h=host))
        .otherwise("")
        .alias("website"),
    )


def probe_case(first_row: Column) -> Column:
    return F.pmod(F.floor(first_row / 8), F.lit(PROBE_KINDS))


def probe_case_table() -> str:
    """``PROBE_CASES`` as a SQL array: the answers of case ``n`` at place ``n``."""

    def lit(value, kind: str) -> str:
        if value is None:
            return f"CAST(NULL AS {kind})"
        return str(value) if kind == "int" else f"'{value}'"

    def answer(case) -> str:
        _, attempt, status, final, error, text = case
        return (
            f"named_struct('attempt', {lit(attempt, 'string')}, 'status_code', {lit(status, 'int')},"
            f" 'final_kind', {lit(final, 'string')}, 'error_kind', {lit(error, 'string')},"
            f" 'error_text', {lit(text, 'string')})"
        )

    cases = [[answer(c) for c in PROBE_CASES if c[0] == n] for n in range(PROBE_KINDS)]
    return "array(" + ", ".join(f"array({', '.join(c)})" if c else "null" for c in cases) + ")"


def probe_log(urls: DataFrame) -> DataFrame:
    """Probe answers of ``url, first_row``: one case per URL."""
    url = F.col("url")
    answers = F.get(F.expr(probe_case_table()), probe_case(F.col("first_row")).cast("int"))
    final_url = (
        F.when(F.col("final_kind") == "same", url)
        .when(F.col("final_kind") == "www", F.replace(url, F.lit("https://"), F.lit("https://www.")))
        .when(F.col("final_kind") == "other", F.lit("https://elsewhere.example.com/home"))
        .when(
            F.col("final_kind") == "social",
            F.replace(url, F.lit("https://"), F.lit("https://www.facebook.com/")),
        )
        .when(F.col("final_kind") == "page", F.concat(url, F.lit("/page")))
    )
    return (
        urls.select("url", F.inline(answers))
        .withColumn("final_url", final_url)
        .drop("final_kind")
    )


def lead_urls(rows: DataFrame) -> DataFrame:
    """``url, first_row`` of leads that carry ``_url``.

    ``url`` is an aggregate, so no filter on it can move below its computation.
    """
    found = rows.groupBy("_url").agg(
        F.max("_url").alias("url"), F.min("row_id").alias("first_row")
    )
    return found.where(F.col("url").isNotNull()).drop("_url")


def page_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored page as captured lately, and an older capture of each, as long as the page.

    Of some sites the homepage has its slash in the later capture, of others in both.
    """
    k = F.col("site_no")
    url = F.concat(
        F.lit("https://"), F.col("host"), choose(F.col("slot"), [F.lit(p) for p in SLOT_PATHS])
    )
    slash = F.when((F.col("slot") == 0) & (k % 5 > 2), "/").otherwise("")
    old_slash = F.when((F.col("slot") == 0) & (k % 5 > 3), "/").otherwise("")
    via = (
        F.when(k % 3 == 0, "api")
        .when((k % 3 == 1) & (F.col("slot") > 0), "api")
        .otherwise("direct")
    )
    broken = (k % 13 == 12) & (F.col("slot") == 0)

    lately = F.struct(
        F.concat(url, slash).alias("url"),
        F.when(broken, 404).otherwise(200).alias("status_code"),
        marked_html().alias("html"),
        F.lit("2024-02-01").cast("timestamp").alias("captured_at"),
    )
    before = F.struct(
        F.concat(url, old_slash).alias("url"),
        F.lit(200).alias("status_code"),
        F.concat(F.lit(OLD_MARKUP), F.col("html")).alias("html"),
        F.lit("2024-01-01").cast("timestamp").alias("captured_at"),
    )
    captures = crawl(spark, sf_dir).select(
        via.alias("fetch_via"), F.inline(F.array(lately, before))
    )
    return captures.select("url", "status_code", "html", "fetch_via", "captured_at")

"""The registered queries: each runs the library over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadsieve.config import DEFAULT_SCRAPE_PATHS, SieveConfig
from leadsieve.functions.decide import DECISIONS, decide
from leadsieve.functions.domains import domain_value, with_normalized_url
from leadsieve.functions.keywords import (
    listed,
    parse_keywords,
    with_campaign_match,
    with_effective_keywords,
    with_keyword_match,
)
from leadsieve.functions.names import with_clean_name, with_site_name
from leadsieve.functions.pages import (
    first_paths,
    is_parked_text,
    page_url,
    path_key,
    path_label,
)
from leadsieve.functions.prompts import build_prompt
from leadsieve.functions.text import SHORT_SNIPPET, html_to_text, snippet
from leadsieve.operators.leads import (
    ROW_ID,
    fill_defaults,
    unify_headers,
    with_working_columns,
)
from leadsieve.operators.pages import FACT_COLUMNS, homepage_source, page_facts
from leadsieve.operators.probes import live_summary, pivot_probes, with_verdict
from leadsieve.operators.report import decision_summary, match_histogram
from leadsieve.plans.qualify import qualify
from leadsieve.sources.csv import (
    BAD_RECORD,
    CSV_FORMAT,
    parsed,
    read_leads,
    read_output,
    recount,
    split_path,
    write_csv,
    write_outputs,
)
from leadsieve.sources.publish import publish_outputs, published, read_published
from leadsieve.sources.storage import scratch_path, settled
from leadsieve.streaming.answers import merge_answers, read_answers
from leadsieve.streaming.intake import (
    BATCH,
    classified_rows,
    read_lead_stream,
    running_summary,
    start_intake,
    store_facts,
)
from workload import derive
from workload.derive import CONFIG, choose, spread, table, text_of

STATUSES = (
    "live", "dead", "timeout", "ssl_error", "invalid_domain", "not_found", "server_error",
    "error", "redirects_to_social", "live_http_only", "redirect", "needs_get", "http_429",
    "unknown", "parked",
)
# Lists as people type them, dealt to campaigns by number; numbers from 0 to CAMPAIGNS - 1 occur.
CAMPAIGNS = 12
CAMPAIGN_PRIMARY = ("Anth, wher", "", "thouf\nder \n", "éè,ung", None)
CAMPAIGN_SECONDARY = ("tion, THE ,und", "el,los", "", "")
CAMPAIGN_NEGATIVE = ("que", "", " zzneg , erst")
# Buckets of the maintained probe answers; the given tables are small.
BUCKETS_HERE = 8
# Folders that documents are written to as CSV.
CSV_FILES = 8
MATCHES = (
    "match", "weak_match", "no_match", "negative_match", "parked_domain", "no_text", "error",
    "skipped", "domain_dead", "not_run",
)
NAME_ENDINGS = (
    "", ", LLC", " L.L.C.", ", Inc.", " Corp", " Corporation", ", Ltd.", " Limited of the West",
    " LP", " L.P.", " LLP", " L.L.P.", " PC", " P.C.", " PLC", " Co.", " &amp; Co - | ",
    " HVAC", " rv of us",
)


def _inputs(spark: SparkSession, sf_dir: str):
    leads = derive.leads(spark, sf_dir)
    log = derive.probe_log(derive.lead_urls(with_working_columns(leads)))
    return leads, log


def normalize_domain(spark, sf_dir):
    leads = derive.leads(spark, sf_dir)
    typed = leads.select("row_id", domain_value(leads.columns).alias("typed")).unionAll(
        table(spark, sf_dir, "pages").select((-1 - F.col("page_id")).alias("row_id"), "url")
    )
    return with_normalized_url(typed, F.col("typed"), "url")


def unify(spark, sf_dir):
    leads = derive.leads(spark, sf_dir)
    return unify_headers(
        leads.select(
            "row_id",
            F.col("company_name").alias("Company Name"),
            F.col("domain").alias("Website"),
        )
    )


def classify_probe(spark, sf_dir):
    _, log = _inputs(spark, sf_dir)
    return with_verdict(pivot_probes(log), CONFIG.request_timeout).select("url", "_probe.*")


def _layer1(spark, sf_dir):
    leads, log = _inputs(spark, sf_dir)
    return qualify(leads, log, config=CONFIG, stages="layer1").drop(ROW_ID)


def live(spark, sf_dir):
    return live_summary(_layer1(spark, sf_dir))


def page_text(spark, sf_dir):
    return derive.crawl(spark, sf_dir).select("row_id", html_to_text(F.col("html")).alias("text"))


def parked(spark, sf_dir):
    pages = derive.crawl(spark, sf_dir).select(
        "row_id", html_to_text(derive.marked_html()).alias("text")
    )
    return pages.withColumn("low", F.lower("text")).select(
        "row_id",
        is_parked_text(F.col("text"), F.col("low")).alias("is_parked"),
        snippet(F.col("text"), SHORT_SNIPPET).alias("short_snippet"),
        snippet(F.col("text")).alias("snippet"),
    )


def company_name(spark, sf_dir):
    pages = derive.crawl(spark, sf_dir).select("row_id", derive.marked_html().alias("html"))
    return with_site_name(pages, "html", "site_name", "name_source").drop("html")


def clean_name(spark, sf_dir):
    names = None
    for name, key, column in (
        ("part", "p_partkey", "p_name"),
        ("customer", "c_custkey", "c_name"),
        ("supplier", "s_suppkey", "s_name"),
        ("nation", "n_nationkey", "n_name"),
    ):
        n = F.col(key).cast("long")
        ending = choose(n, [F.lit(e) for e in NAME_ENDINGS])
        spelled = F.concat(F.col(column), ending)
        spelled = choose(n, [F.upper(spelled), F.lower(spelled), spelled, spelled])
        part = table(spark, sf_dir, name).select(
            F.lit(name).alias("origin"), n.alias("key"), spelled.alias("typed")
        )
        names = part if names is None else names.unionAll(part)
    return with_clean_name(spread(names, "key"), F.col("typed"), "clean")


def match(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    docs = docs.withColumn("low", F.lower("text"))
    both = with_keyword_match(docs, "text", "low", CONFIG)
    both = both.select(
        "doc_id", "text", "low",
        F.col("match_result").alias("plain_result"),
        listed(F.col("matched")).alias("plain_matched"),
        listed(F.col("negatives")).alias("plain_negatives"),
    )
    strict = SieveConfig.from_mapping(
        {
            "industry_keywords": {
                "primary": ["anth", "Wher", "anth"],
                "secondary": ["tion", "THE "],
                "negative": ["que", "es"],
            },
            "keyword_match_rules": {
                "primary_threshold": 3, "secondary_threshold": 2, "negative_override": False,
            },
        }
    )
    return with_keyword_match(both, "text", "low", strict).select(
        "doc_id", "plain_result", "plain_matched", "plain_negatives",
        F.col("match_result").alias("strict_result"),
        listed(F.col("matched")).alias("strict_matched"),
        listed(F.col("negatives")).alias("strict_negatives"),
    )


def candidate_path_table(spark, sf_dir):
    """Candidate paths per page: its own links come first."""
    links = F.regexp_extract_all(F.col("html"), F.lit('href="([^"]+)"'), F.lit(1))
    paths = F.concat(links, F.array(*[F.lit(p) for p in DEFAULT_SCRAPE_PATHS]))
    rows = table(spark, sf_dir, "pages").select("page_id", paths.alias("paths"))
    rows = rows.withColumn("keys", F.transform("paths", path_key))
    kept = rows.select(
        "page_id", F.posexplode(first_paths(F.col("paths"), F.col("keys"), 8)).alias("pos", "path")
    )
    base = text_of("https://p{n}.example.org/", n=F.col("page_id"))
    return kept.select(
        "page_id", "pos", "path",
        page_url(base, F.col("path")).alias("page_url"),
        path_label(F.col("path")).alias("label"),
    )


def homepage_text(spark, sf_dir):
    return homepage_source(derive.page_snapshot(spark, sf_dir), use_api=True)


def _facts(spark, sf_dir, use_api) -> DataFrame:
    facts = page_facts(derive.page_snapshot(spark, sf_dir), CONFIG, use_api)
    return facts.select("url", *FACT_COLUMNS)


def subpage_bundle(spark, sf_dir):
    return _facts(spark, sf_dir, use_api=True)


def subpage_bundle_direct(spark, sf_dir):
    return _facts(spark, sf_dir, use_api=False)


def defaults(spark, sf_dir):
    """Rows in every state: with facts, without, failed, without URL, not live."""
    rows = with_working_columns(derive.leads(spark, sf_dir))
    n = F.col("row_id")
    facts = F.struct(
        *[F.concat(F.lit(f"{c} "), n.cast("string")).alias(c) for c in FACT_COLUMNS]
    )
    rows = rows.select(
        "*",
        choose(n, [F.lit(s) for s in STATUSES]).alias("domain_status"),
        F.when(n % 4 != 0, facts).alias("_facts"),
        F.when(n % 7 == 0, F.repeat(F.lit("failure "), F.lit(40))).alias("_failure"),
    )
    return fill_defaults(rows, "both").select("row_id", "domain_status", *FACT_COLUMNS)


def classify(spark, sf_dir):
    n = F.col("row_id")
    rows = derive.leads(spark, sf_dir).select(
        "row_id",
        choose(n, [F.lit(s) for s in STATUSES]).alias("domain_status"),
        choose(F.floor(n / 2), [F.lit(m) for m in MATCHES]).alias("industry_match"),
        F.concat(F.lit("kw "), n.cast("string")).alias("matched_keywords"),
        F.when(n % 3 > 0, F.concat(F.lit("no "), n.cast("string"))).alias("negative_keywords"),
    )
    verdict = decide(*[F.col(c) for c in rows.columns[1:]])
    return rows.select("row_id", "domain_status", "industry_match", verdict.alias("v")).select(
        "row_id", "domain_status", "industry_match", "v.*"
    )


def prompt(spark, sf_dir):
    n = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        build_prompt(
            F.when(n % 5 == 0, "").when(n % 5 != 1, F.col("text")),
            F.when(n % 3 == 0, "").when(n % 3 != 1, F.col("source")),
        ).alias("prompt"),
    )


def keyword_lists(spark, sf_dir):
    """Whole documents as typed keyword lists; some requests leave lists empty."""
    n = F.col("doc_id")
    typed = spread(table(spark, sf_dir, "documents"), "doc_id").select(
        "doc_id",
        parse_keywords(F.when(n % 3 != 0, F.col("text"))).alias("p"),
        parse_keywords(
            F.when(n % 4 < 2, text_of("{l} ,\n,\tX {s}", l=F.col("lang"), s=F.col("source")))
        ).alias("s"),
        parse_keywords(F.when(n % 5 < 3, F.col("text"))).alias("n"),
    )
    used = with_effective_keywords(typed, "p", "s", "n", CONFIG)
    return used.select(
        "doc_id",
        F.array_join("p", "|").alias("primary_terms"),
        F.array_join("s", "|").alias("secondary_terms"),
        F.array_join("n", "|").alias("negative_terms"),
    )


def campaign_match(spark, sf_dir):
    """Every document against the lists typed for its campaign; some campaigns are unknown."""
    n = F.col("s_suppkey")
    campaigns = table(spark, sf_dir, "supplier").select(
        n.alias("campaign_id"),
        choose(n, [F.lit(x) for x in CAMPAIGN_PRIMARY]).alias("primary"),
        choose(n, [F.lit(x) for x in CAMPAIGN_SECONDARY]).alias("secondary"),
        choose(n, [F.lit(x) for x in CAMPAIGN_NEGATIVE]).alias("negative"),
    )
    docs = spread(table(spark, sf_dir, "documents"), "doc_id").select(
        "doc_id", "text", (F.col("doc_id") % CAMPAIGNS).alias("campaign_id")
    )
    return with_campaign_match(docs, campaigns, "text", CONFIG).select(
        "doc_id", "campaign_id", "match_result",
        listed(F.col("matched")).alias("matched_keywords"),
        listed(F.col("negatives")).alias("negative_keywords"),
    )


def full(spark, sf_dir, **options):
    leads, log = _inputs(spark, sf_dir)
    snapshot = derive.page_snapshot(spark, sf_dir)
    return qualify(leads, log, snapshot, CONFIG, **options).drop(ROW_ID)


def full_api(spark, sf_dir):
    return full(spark, sf_dir, use_api=True)


def histogram(spark, sf_dir):
    return match_histogram(full(spark, sf_dir, describe=False))


def summary(spark, sf_dir):
    return decision_summary(full(spark, sf_dir, describe=False))


def skip_layer1(spark, sf_dir):
    """Layer 2 alone, on leads that bring a domain status."""
    n = F.col("row_id")
    leads = derive.leads(spark, sf_dir).withColumns(
        {
            "domain_status": choose(n, [F.lit(s) for s in STATUSES[:1] + STATUSES[9:13]]),
            "http_code": F.lit(200),
            "redirect_url": F.lit("https://before.example.com"),
        }
    )
    snapshot = derive.page_snapshot(spark, sf_dir)
    return qualify(leads, page_snapshot=snapshot, config=CONFIG, stages="layer2").drop(ROW_ID)


def _lead_files(spark, sf_dir) -> str:
    """The derived leads as CSV files in a new folder, as many as the bytes of the leads ask for.

    Leads are narrow: one file for each split of the wide tables they come from would be a thousand small ones.
    """
    path = scratch_path(spark, "leads.csv")
    derive.leads(spark, sf_dir).hint("rebalance").write.options(**CSV_FORMAT).csv(path)
    return path


def csv_roundtrip(spark, sf_dir):
    """Leads from CSV, classified, written as CSV, read back from the three splits."""
    leads = read_leads(spark, _lead_files(spark, sf_dir))
    _, log = _inputs(spark, sf_dir)
    done = qualify(leads, log, derive.page_snapshot(spark, sf_dir), CONFIG)
    out = scratch_path(spark, "out.csv")
    write_outputs(done, out)
    rows = None
    for decision in DECISIONS:
        part = read_output(spark, split_path(out, decision)).withColumn("split", F.lit(decision))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def csv_ordered(spark, sf_dir):
    """An ordered output read back: whether row numbers are those of the input and follow its order.

    The input's files are in order of ``row_id``, so numbers without gaps must be so as well, and the rows of
    the output must stand at the places that their numbers name.
    """
    folder = scratch_path(spark, "leads.csv")
    derive.leads(spark, sf_dir).orderBy("row_id").write.options(**CSV_FORMAT).csv(folder)
    leads = read_leads(spark, folder)
    leads = leads.withColumn("place_in", F.col(ROW_ID).cast("string"))
    _, log = _inputs(spark, sf_dir)
    out = scratch_path(spark, "ordered.csv")
    write_csv(qualify(leads, log, config=CONFIG, stages="layer1"), out, ordered=True)
    rows = parsed(spark, out).select(
        F.col(ROW_ID).alias("place_out"),
        F.col("place_in").cast("long").alias("place_in"),
        F.col("row_id").cast("long").alias("row_id"),
    )
    rows = rows.withColumn("run", F.expr("place_out div 4096"))
    before = F.lag("row_id").over(Window.partitionBy("run").orderBy("place_out"))
    runs = rows.withColumn("before", before).groupBy("run").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("before") >= F.col("row_id")).alias("late"),
        F.count_if(F.col("place_in") != F.col("place_out")).alias("misplaced"),
        F.max("place_out").alias("last"),
        F.min("row_id").alias("low"),
        F.max("row_id").alias("high"),
    )
    # one row per run of places from here on
    between = runs.withColumn("before", F.lag("high").over(Window.orderBy("run")))
    late = F.sum("late") + F.count_if(F.col("before") >= F.col("low"))
    return between.agg(
        F.sum("n").alias("n_rows"), late.alias("out_of_order"), F.sum("misplaced").alias("misplaced"), F.max("last").alias("last_place")
    )


def _write_in_order(lines: DataFrame, header: Column, folder: str) -> None:
    """Files of ``lines(p, place, value)`` in order of ``p`` and ``place``, each with the header as its first line.

    Ranges of rows are dealt to as many tasks as the session shuffles with, so no file grows with the table.
    """
    spark = lines.sparkSession
    headers = spark.range(CSV_FILES).select(F.col("id").alias("p"), F.lit(-1).cast("long").alias("place"), header.alias("value"))
    ranged = headers.unionAll(lines).repartitionByRange("p", "place").sortWithinPartitions("p", "place")
    # a range that begins inside a folder begins a file of its own there
    begins = (F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0) & (F.col("place") >= 0)
    first = F.concat(header, F.lit("\n"), F.coalesce("value", F.lit("")))
    ranged.select("p", F.when(begins, first).otherwise(F.col("value")).alias("value")).write.partitionBy("p").text(folder)


def csv_records(spark, sf_dir):
    """Documents in CSV files, line breaks and all; every seventh record has a field too many and is listed."""
    docs = table(spark, sf_dir, "documents")
    text = F.concat(F.lit('"'), F.replace(F.coalesce("text", F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    surplus = F.when(F.col("doc_id") % 7 == 3, ",x").otherwise("")
    record = F.concat(F.col("doc_id").cast("string"), F.lit(","), text, F.lit(","), "source", surplus)
    lines = docs.select((F.col("doc_id") % CSV_FILES).alias("p"), F.col("doc_id").alias("place"), record.alias("value"))
    folder = scratch_path(spark, "documents.csv")
    _write_in_order(lines, F.lit("company_name,domain,website"), folder)
    return read_leads(spark, folder).select(
        F.col(ROW_ID).alias("place"),
        F.col("company_name").alias("doc"),
        F.md5("domain").alias("text_md5"),
        "website",
        F.md5(BAD_RECORD).alias("bad_md5"),
    )


def csv_recount(spark, sf_dir):
    """Counts taken from the written file of all rows."""
    leads = read_leads(spark, _lead_files(spark, sf_dir))
    _, log = _inputs(spark, sf_dir)
    out = scratch_path(spark, "out.csv")
    write_outputs(qualify(leads, log, derive.page_snapshot(spark, sf_dir), CONFIG), out)
    return recount(spark, out)


def _stored_answers(spark, sf_dir, work: str) -> str:
    """The probe log as a maintained table, merged in batches: some answers come late, one batch comes twice."""
    log = settled(_inputs(spark, sf_dir)[1], "log")
    now = log.withColumn("probed_at", F.lit("2024-02-01").cast("timestamp"))
    before = now.where("attempt = 'head_https'").withColumns(
        {"probed_at": F.lit("2024-01-01").cast("timestamp"), "status_code": F.lit(500)}
    )
    even = F.pmod(F.xxhash64("url"), F.lit(2)) == 0
    first, second, third = before.where(even).unionByName(now.where(~even)), now.where(even), before.where(~even)
    for number, batch in ((0, first), (1, second), (1, second), (2, third)):
        merge_answers(f"{work}/answers", batch, number, BUCKETS_HERE)
    return f"{work}/answers"


def probe_state(spark, sf_dir):
    answers = _stored_answers(spark, sf_dir, scratch_path(spark, "state"))
    log = read_answers(spark, answers, buckets=BUCKETS_HERE)
    return with_verdict(pivot_probes(log), CONFIG.request_timeout).select("url", "_probe.*")


def _intake(spark, sf_dir) -> str:
    """The derived leads through the stream; facts and probe answers are stored first."""
    folder = _lead_files(spark, sf_dir)
    work = scratch_path(spark, "intake")
    facts = store_facts(derive.page_snapshot(spark, sf_dir), CONFIG, f"{work}/facts")
    answers = _stored_answers(spark, sf_dir, work)
    query = start_intake(
        read_lead_stream(spark, folder, files_per_batch=4), answers, facts, CONFIG,
        f"{work}/out", f"{work}/progress", BUCKETS_HERE,
    )
    query.awaitTermination()
    return f"{work}/out"


def stream_intake(spark, sf_dir):
    rows = classified_rows(spark, _intake(spark, sf_dir)).drop(ROW_ID, BATCH)
    return rows.withColumn("http_code", F.col("http_code").cast("string")).na.fill("")


def csv_published(spark, sf_dir):
    """Two versions of the outputs, published one after the other: what the current one says and holds."""
    leads, log = _inputs(spark, sf_dir)
    path = scratch_path(spark, "published")
    publish_outputs(qualify(leads, log, config=CONFIG, stages="layer1"), path)
    publish_outputs(full(spark, sf_dir, describe=False), path)
    current = published(spark, path)
    held = [read_published(spark, path, r.output).select(F.lit(r.output).alias("output")) for r in current.collect()]
    counted = reduce(DataFrame.unionAll, held).groupBy("output").agg(F.count("*").alias("held"))
    return current.join(counted, "output", "left").select(
        "output", "row_count", F.coalesce("held", F.lit(0)).alias("held")
    )


def stream_totals(spark, sf_dir):
    """The summary of all rows, added up from what the batches of the stream counted."""
    return running_summary(spark, _intake(spark, sf_dir))


QUERIES = {
    "q_normalize_domain": normalize_domain,
    "q_unify_headers": unify,
    "q_classify_probe": classify_probe,
    "q_live_summary": live,
    "q_html_to_text": page_text,
    "q_homepage_source": homepage_text,
    "q_parked": parked,
    "q_company_name": company_name,
    "q_clean_name": clean_name,
    "q_match_keywords": match,
    "q_match_histogram": histogram,
    "q_candidate_paths": candidate_path_table,
    "q_subpage_bundle": subpage_bundle,
    "q_subpage_bundle_direct": subpage_bundle_direct,
    "q_defaults": defaults,
    "q_classify_row": classify,
    "q_decision_summary": summary,
    "q_prompt": prompt,
    "q_keyword_lists": keyword_lists,
    "q_campaign_match": campaign_match,
    "q_layer1_only": _layer1,
    "q_skip_layer1": skip_layer1,
    "q_qualify_full": full,
    "q_qualify_api": full_api,
    "q_csv_roundtrip": csv_roundtrip,
    "q_csv_recount": csv_recount,
    "q_csv_ordered": csv_ordered,
    "q_csv_records": csv_records,
    "q_csv_published": csv_published,
    "q_probe_state": probe_state,
    "q_stream_intake": stream_intake,
    "q_stream_totals": stream_totals,
}

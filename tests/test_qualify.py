from datetime import datetime

import pytest

from leadsieve import SieveConfig, qualify
from leadsieve.operators.leads import OUTPUT_COLUMNS, ROW_ID, unify_headers
from leadsieve.operators.pages import page_facts
from leadsieve.operators.report import decision_summary, display_percent, match_histogram
from leadsieve.plans.qualify import broadcast_limit
from pyspark.sql import functions as F

LOG = "url string, attempt string, status_code int, final_url string, error_kind string, error_text string"
SNAPSHOT = "url string, status_code int, html string, fetch_via string, captured_at timestamp"
CFG = SieveConfig().with_keywords(["pump"], ["tank", "drain"], ["food"])
WORDS = "plain words about the company " * 10


def inputs(spark, copies=1):
    leads = [
        ("Good Co", "https://www.good.com/x", ""),
        ("", "good.com", ""),
        ("Weak", "", "weak.com"),
        ("Dead", "dead.com", ""),
        ("Gone", "gone.com", ""),
        ("No page", "empty.com", ""),
        ("Busy", "busy.com", ""),
        ("Unprobed", "unprobed.com", ""),
        ("Nothing", None, None),
        ("Social", "facebook.com/x", ""),
    ] * copies
    log = [
        (f"https://{h}.com", "head_https", code, f"https://{h}.com", None, None)
        for h, code in (("good", 200), ("weak", 301), ("gone", 404), ("empty", 200), ("busy", 429))
    ] + [("https://dead.com", "head_https", None, None, "connect", None)]
    now = datetime(2024, 1, 1)
    pages = [
        ("https://good.com", 200, f"<title>Good Pumps, Inc.</title>pump {WORDS}", "direct", now),
        ("https://weak.com", 200, f"<title>Home</title>tank {WORDS}", "direct", now),
        ("https://dead.com", 200, f"pump {WORDS}", "direct", now),
    ]
    return (
        spark.createDataFrame(leads, "company_name string, domain string, website string"),
        spark.createDataFrame(log, LOG),
        spark.createDataFrame(pages, SNAPSHOT),
    )


def rows(frame):
    return [tuple(r) for r in frame.orderBy(ROW_ID).drop(ROW_ID).collect()]


def brief(frame):
    kept = frame.select(
        ROW_ID, "company_name", "domain_status", "industry_match", "resolved_name", "name_source",
        "filter_decision", "filter_reason",
    )
    return rows(kept)


FULL = [
    ("Good Co", "live", "match", "Good Pumps", "title_tag", "PASS", "Keywords: pump"),
    ("", "live", "match", "Good Pumps", "title_tag", "PASS", "Keywords: pump"),
    ("Weak", "redirect", "weak_match", "Weak", "fallback", "REVIEW", "Weak match: tank"),
    ("Dead", "dead", "domain_dead", "Dead", "domain_dead", "FAIL", "Domain: dead"),
    ("Gone", "not_found", "domain_dead", "Gone", "domain_dead", "FAIL", "Domain: not_found"),
    ("No page", "parked", "parked_domain", "No page", "parked_domain", "FAIL", "Parked/dead domain"),
    ("Busy", "http_429", "domain_dead", "Busy", "domain_dead", "REVIEW", "Unclassified: http_429/domain_dead"),
    ("Unprobed", "unknown", "domain_dead", "Unprobed", "domain_dead", "REVIEW", "Unclassified: unknown/domain_dead"),
    ("Nothing", "invalid_domain", "domain_dead", "Nothing", "domain_dead", "FAIL", "Domain: invalid_domain"),
    ("Social", "invalid_domain", "domain_dead", "Social", "domain_dead", "FAIL", "Domain: invalid_domain"),
]


def test_both_stages(spark):
    done = qualify(*inputs(spark), CFG)
    assert brief(done) == FULL
    assert done.columns == [ROW_ID, "company_name", "domain", "website", *OUTPUT_COLUMNS]


def test_layer1_only(spark):
    leads, log, _ = inputs(spark)
    got = brief(qualify(leads, log, stages="layer1"))
    assert [r[1] for r in got[:4]] == ["live", "live", "redirect", "dead"]
    assert {r[2] for r in got} == {"not_run"} and {r[4] for r in got} == {"not_run"}
    assert got[0][5:] == ("REVIEW", "Unclassified: live/not_run")


def test_layer2_only_keeps_what_was_not_looked_at(spark):
    leads, log, pages = inputs(spark)
    first = qualify(leads, log, stages="layer1").withColumn(
        "negative_keywords", F.concat(F.lit("old "), "company_name")
    )
    again = qualify(first, page_snapshot=pages, config=CFG, stages="layer2")
    got = {r.company_name: r for r in again.collect()}
    assert got["Good Co"].filter_decision == "PASS" and got["Good Co"].http_code == 200
    assert got["Good Co"].negative_keywords == ""
    assert got["No page"].domain_status == "parked"
    assert got["No page"].negative_keywords == "old No page"
    assert got["Dead"].industry_match == got["Dead"].name_source == "not_run"
    assert got["Dead"].filter_reason == "Domain: dead"
    assert again.columns == [ROW_ID, "company_name", "domain", "website", *OUTPUT_COLUMNS]


def test_layer2_without_url_is_skipped(spark):
    _, _, pages = inputs(spark)
    leads = spark.createDataFrame([("A", None, "live")], "company_name string, domain string, domain_status string")
    row = qualify(leads, page_snapshot=pages, config=CFG, stages="layer2").first()
    assert (row.industry_match, row.name_source, row.resolved_name) == ("skipped", "skipped", "A")
    assert row.filter_reason == "Could not extract text: skipped"


@pytest.mark.parametrize("slice_rows", [1, 3, 7, 10_000])
def test_hot_urls_in_slices_give_the_same_rows(spark, slice_rows):
    leads, log, pages = inputs(spark, copies=12)
    done = qualify(leads, log, pages, CFG, slice_rows=slice_rows)
    assert brief(done) == FULL * 12


@pytest.mark.parametrize("limit", ["-1", "1b", "10MB"])
def test_join_layout_does_not_change_rows(spark, limit):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        leads, log, pages = inputs(spark)
        assert brief(qualify(leads, log, pages, CFG)) == FULL
        facts = page_facts(pages, CFG)
        assert brief(qualify(leads, log, facts=facts, config=CFG)) == FULL
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_broadcast_limit(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for text, want in (("10485760", 10 << 20), ("10MB", 10 << 20), ("2g", 2 << 30), ("7b", 7), ("-1", -1), ("5k", 5120)):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", text)
            assert broadcast_limit(spark.range(1)) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_empty_input(spark):
    leads, log, pages = inputs(spark)
    done = qualify(leads.limit(0), log, pages, CFG)
    assert done.count() == 0
    assert tuple(decision_summary(done).first()) == (0, 0, 0, 0, None, None, None)
    assert match_histogram(done).collect() == []


def test_refused_inputs(spark):
    leads, log, pages = inputs(spark)
    for call in (
        lambda: qualify(leads, log, pages),
        lambda: qualify(leads, log, pages, SieveConfig().with_keywords(negative=["x"])),
        lambda: qualify(leads, None, pages, CFG),
        lambda: qualify(leads, log, None, CFG),
        lambda: qualify(leads, page_snapshot=pages, config=CFG, stages="layer2"),
        lambda: qualify(leads, log, pages, CFG, stages="layer3"),
    ):
        with pytest.raises(ValueError):
            call()


def test_headers(spark):
    def unified(names, values):
        frame = spark.createDataFrame([values], ", ".join(f"`{n}` string" for n in names))
        out = unify_headers(frame)
        return out.columns, tuple(out.first())

    assert unified(["website", "CompanyName"], ["w", "c"]) == (
        ["website", "CompanyName", "domain", "company_name"], ("w", "c", "w", "c"),
    )
    assert unified(["domain", "website"], ["", "w"]) == (["domain", "website"], ("", "w"))
    assert unified(["Domain", "Company Name"], ["d", "c"]) == (
        ["domain", "Company Name", "company_name"], ("d", "c", "c"),
    )
    assert unified(["x"], ["1"]) == (["x"], ("1",))
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        assert unified(["Domain", "Website"], ["d", "w"]) == (
            ["Domain", "Website", "domain"], ("d", "w", "d"),
        )
        assert unified(["Domain", "domain"], ["d", "w"])[0] == ["Domain", "domain"]
    finally:
        spark.conf.unset("spark.sql.caseSensitive")


def test_leads_without_known_columns(spark):
    _, log, pages = inputs(spark)
    leads = spark.createDataFrame([("x",)], "other string")
    row = qualify(leads, log, pages, CFG).first()
    assert (row.other, row.domain_status, row.resolved_name) == ("x", "invalid_domain", "")


def test_company_name_falls_back_to_second_header(spark):
    _, log, pages = inputs(spark)
    leads = spark.createDataFrame([("", "Second", "dead.com")], "company_name string, `Company Name` string, domain string")
    assert qualify(leads, log, pages, CFG).first().resolved_name == "Second"


def test_reports(spark):
    frame = spark.createDataFrame([("b", "PASS"), ("a", "FAIL"), ("c", "FAIL"), ("c", "FAIL")], "industry_match string, filter_decision string")
    assert [tuple(r) for r in match_histogram(frame).collect()] == [("c", 2, 50.0), ("a", 1, 25.0), ("b", 1, 25.0)]
    assert tuple(decision_summary(frame).first()) == (4, 1, 3, 0, 25.0, 75.0, 0.0)
    shown = spark.createDataFrame([(6.25,), (6.35,)], "p double").select(display_percent("p").alias("p"))
    assert [r.p for r in shown.collect()] == [6.2, 6.4]

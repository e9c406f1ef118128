from datetime import datetime

from leadsieve.config import SieveConfig, candidate_paths
from leadsieve.functions.pages import first_paths, page_url, path_key, path_label
from leadsieve.operators.membership import among, members
from leadsieve.operators.pages import (
    captures,
    chosen_pages,
    homepage_facts,
    homepage_source,
    is_followed,
    of_sites,
    page_facts,
    reduce_homepages,
    reduce_subpages,
    site_of,
    subpage_numbers,
)
from pyspark.sql import functions as F

SNAPSHOT = "url string, status_code int, html string, fetch_via string, captured_at timestamp"
CFG = SieveConfig().with_keywords(["pump"], ["tank", "drain"], ["food"])
WORDS = "plain words about the company " * 10


def page(url, html, via="direct", day=1, status=200):
    return (url, status, html, via, datetime(2024, 1, day) if day else None)


def facts(spark, rows, cfg=CFG, use_api=False, **options):
    frame = spark.createDataFrame(rows, SNAPSHOT)
    return {r.url: r for r in page_facts(frame, cfg, use_api, **options).collect()}


def home(word, title="Acme"):
    return f"<title>{title}</title><p>{word} {WORDS}</p>"


def test_bundle_holds_candidate_pages_in_order(spark):
    rows = [
        page("https://a.com", home("pump")),
        page("https://a.com/about-us", home("third")),
        page("https://a.com/services", home("first")),
        page("https://a.com/about", "short"),
        page("https://a.com/what-we-do", home("cut off")),
        page("https://a.com/services/", home("other spelling")),
    ]
    got = facts(spark, rows)["https://a.com"]
    text = f"Acme {{}} {WORDS.strip()}"
    assert got.scraped_text == "\n\n".join(
        [
            "=== HOMEPAGE ===\n" + text.format("pump"),
            "=== SERVICES PAGE ===\n" + text.format("first"),
            "=== ABOUT US PAGE ===\n" + text.format("third"),
        ]
    )
    assert got.pages_scraped == "homepage;/services;/about-us"
    assert (got.industry_match, got.matched_keywords, got.negative_keywords) == ("match", "pump", "")
    assert (got.resolved_name, got.name_source) == ("Acme", "title_tag")


def test_sub_pages_only_for_matches(spark):
    rows = []
    for name, word in {"m": "pump", "w": "tank", "n": "none", "x": "pump food"}.items():
        rows += [page(f"https://{name}.com", home(word)), page(f"https://{name}.com/about", home("sub"))]
    got = facts(spark, rows)
    assert {u[8]: r.industry_match for u, r in got.items()} == {
        "m": "match", "w": "weak_match", "n": "no_match", "x": "negative_match",
    }
    assert {u[8]: r.pages_scraped for u, r in got.items()} == {
        "m": "homepage;/about", "w": "homepage;/about", "n": "homepage", "x": "homepage",
    }
    assert got["https://x.com"].negative_keywords == "food"
    assert "ABOUT PAGE" not in got["https://n.com"].scraped_text


def test_size_limits(spark):
    long = "pump " + "word " * 4000
    rows = [page("https://a.com", long)]
    rows += [page(f"https://a.com/{p}", long) for p in ("services", "about", "about-us")]
    got = facts(spark, rows)["https://a.com"]
    assert len(got.scraped_text) == 8000 and len(got.homepage_snippet) == 300
    assert got.scraped_text.index("=== SERVICES") == len("=== HOMEPAGE ===\n") + 3000 + 2


def test_parked_and_failed_homepages(spark):
    rows = [
        page("https://p.com", home("pump. This domain is for SALE")),
        page("https://s.com", "<title>Acme</title>pump"),
        page("https://f.com", home("pump"), status=404),
        page("https://f.com/about", home("sub")),
        page("https://e.com", None),
    ]
    for url, row in facts(spark, rows).items():
        assert row.industry_match == row.name_source == "parked_domain", url
        assert (row.matched_keywords, row.scraped_text, row.pages_scraped) == ("", "", "")
        assert row.negative_keywords is None and row.resolved_name is None
    assert facts(spark, rows)["https://s.com"].homepage_snippet == "Acme pump"
    assert len(facts(spark, rows)["https://p.com"].homepage_snippet) == 200


def test_latest_capture_counts_even_if_it_failed(spark):
    url = "https://a.com"
    old, new = page(url, home("pump"), day=1), page(url, home("none"), day=2)
    assert facts(spark, [old, new])[url].industry_match == "no_match"
    assert facts(spark, [new, old])[url].industry_match == "no_match"
    failed = page(url, None, day=3, status=500)
    assert facts(spark, [old, new, failed])[url].industry_match == "parked_domain"
    undated = page(url, home("pump"), day=None)
    assert facts(spark, [undated, new])[url].industry_match == "no_match"
    tie = [page(url, home("pump")), page(url, home("none"))]
    assert facts(spark, tie)[url] == facts(spark, tie[::-1])[url]


def test_service_before_direct_fetch(spark):
    rows = [
        page("https://a.com", home("pump", "Service"), "api"),
        page("https://a.com", home("none", "Direct")),
        page("https://b.com", "<script>x</script>", "api"),
        page("https://b.com", home("tank", "Direct")),
        page("https://b.com/about", home("direct sub")),
        page("https://b.com/services", home("service sub"), "api"),
    ]
    got = facts(spark, rows, use_api=True)
    assert got["https://a.com"].resolved_name == "Service"
    assert got["https://b.com"].resolved_name == "Direct"
    assert got["https://b.com"].pages_scraped == "homepage;/services"
    plain = facts(spark, rows)
    assert plain["https://a.com"].resolved_name == "Direct"
    assert plain["https://b.com"].pages_scraped == "homepage;/about"
    source = homepage_source(spark.createDataFrame(rows, SNAPSHOT), use_api=True)
    assert {r.url: r.text_via for r in source.collect()} == {
        "https://a.com": "api", "https://b.com": "direct",
    }


def test_two_paths_with_one_address(spark):
    cfg = SieveConfig(primary=("pump",), scrape_paths=("team", "/team"), scrape_max_subpages=2)
    rows = [page("https://a.com", home("pump")), page("https://a.com/team", home("sub"))]
    got = facts(spark, rows, cfg)["https://a.com"]
    assert got.pages_scraped == "homepage;team;/team"
    assert got.scraped_text.count("=== TEAM PAGE ===") == 2


def test_a_site_with_a_third_of_all_captures(spark):
    hot = [page("https://hot.com", home("none"), day=d % 28 + 1) for d in range(200)]
    hot += [page("https://hot.com", home("pump"), day=29)]
    cold = [page(f"https://c{i}.com", home("tank")) for i in range(400)]
    got = facts(spark, hot + cold)
    assert len(got) == 401
    assert got["https://hot.com"].industry_match == "match"
    assert {got[f"https://c{i}.com"].industry_match for i in range(400)} == {"weak_match"}


def test_homepages_with_and_without_slash_are_one(spark):
    late, early = page("https://a.com/", home("pump"), day=2), page("https://a.com", home("none"), day=1)
    assert facts(spark, [late, early])["https://a.com"].industry_match == "match"
    swapped = [page("https://a.com/", home("pump"), day=1), page("https://a.com", home("none"), day=2)]
    assert facts(spark, swapped)["https://a.com"].industry_match == "no_match"
    source = homepage_source(spark.createDataFrame([late, early, page("https://a.com//", "no")], SNAPSHOT)).collect()
    assert [(r.url, r.text_via, "pump" in r.text) for r in source] == [("https://a.com", "direct", True)]


def test_superseded_captures_and_unfollowed_sub_pages_are_not_parsed(spark):
    rows = []
    for i in range(40):
        word = "pump" if i % 4 == 0 else "none"
        for day in range(1, 6):
            rows += [page(f"https://s{i}.com/{p}", home(word), day=day) for p in ("", "about", "services", "other")]
    snapshot = spark.createDataFrame(rows, SNAPSHOT)
    paths = candidate_paths(CFG)
    latest_of = captures(snapshot, paths, False)
    homes = reduce_homepages(chosen_pages(snapshot, latest_of, (0,), (), False), CFG, True)
    assert homes.count() < 1.2 * 40 and homes.select("site").distinct().count() == 40
    sites = homepage_facts(snapshot, latest_of, CFG, False, True)
    assert sites.where(is_followed(F.col("verdict"))).count() == 10
    followed = latest_of.join(sites.where(is_followed(F.col("verdict"))), "site", "left_semi")
    subs = reduce_subpages(chosen_pages(snapshot, followed, subpage_numbers(paths), paths, False))
    assert 20 <= subs.count() < 1.2 * 20 + 5


def test_captures_of_wanted_sites_alone(spark):
    rows = [page(f"https://s{i}.com", home("pump")) for i in range(30)]
    wanted = spark.createDataFrame([(f"https://s{i}.com",) for i in range(3)] * 2, "url string")
    got = page_facts(spark.createDataFrame(rows, SNAPSHOT), CFG, sites=wanted)
    assert sorted(r.url for r in got.collect()) == [f"https://s{i}.com" for i in range(3)]


def test_without_description(spark):
    rows = [page("https://a.com", home("pump")), page("https://a.com/about", home("sub")), page("https://b.com", "x")]
    got = facts(spark, rows, describe=False)
    assert {u: (r.industry_match, r.matched_keywords) for u, r in got.items()} == {
        "https://a.com": ("match", "pump"), "https://b.com": ("parked_domain", ""),
    }
    assert all(r.scraped_text is None and r.resolved_name is None for r in got.values())


def test_captures_without_time_are_settled_by_content(spark):
    rows = [page("https://a.com", home(w), day=None) for w in ("pump", "none", "tank", "pump")]
    first = facts(spark, rows)["https://a.com"]
    for turn in range(1, 4):
        assert facts(spark, rows[turn:] + rows[:turn])["https://a.com"] == first


def test_sites_beyond_a_broadcast_are_left_for_later(spark):
    frame = spark.createDataFrame([page("https://a.com/x", "1"), page("https://b.com", "2")], SNAPSHOT)
    sites = spark.createDataFrame([("https://a.com",), ("https://a.com",)], "url string")
    site = site_of(frame["url"])
    assert [r.url for r in of_sites(frame, site, sites, True).collect()] == ["https://a.com/x"]
    assert of_sites(frame, site, sites, False).count() == 2


def test_paths(evaluate, spark):
    labels = {"/about-us": "ABOUT US", "//a/b//": "A > B", "x": "X", "/": ""}
    assert evaluate(path_label, list(labels)) == list(labels.values())
    urls = evaluate(lambda v: page_url(F.lit("https://a.com//"), v), ["/x", "x", "//x/"])
    assert urls == ["https://a.com/x", "https://a.com/x", "https://a.com/x/"]
    frame = spark.createDataFrame([(["/A/", "/a", "b", "B//", "c", "/c"],)], "p array<string>")
    frame = frame.withColumn("k", F.transform("p", path_key))
    assert frame.select(first_paths(F.col("p"), F.col("k"), 3).alias("r")).first().r == ["/A/", "b", "c"]


def test_bitmaps(spark):
    key = F.xxhash64("id")
    table = spark.range(20_000)
    for n, limit in ((0, 1 << 20), (1, 1 << 20), (3000, 1 << 20), (3000, 512), (3000, 1)):
        kept = among(table, key, members(spark.range(n).select(key), limit)).cache()
        assert kept.where(F.col("id") < n).count() == n
        assert kept.columns == ["id"]
        if limit > 512:
            assert kept.count() <= n + 2000
    assert members(spark.range(3000).select(key), 4096).bits == 1 << 15


def test_a_full_bitmap_still_leaves_pages_out(spark):
    """More keys than bits: other keys pass more often, but not all of them, and none that is wanted is lost."""
    key = F.xxhash64("id")
    wanted = members(spark.range(40_000).select(key), 4096)
    passed = among(spark.range(80_000), key, wanted)
    assert wanted.bits == 1 << 15
    assert passed.where("id < 40000").count() == 40_000
    assert passed.where("id >= 40000").count() < 0.75 * 40_000

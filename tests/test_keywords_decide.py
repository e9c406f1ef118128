import random

import pytest

from leadsieve.config import SieveConfig
from leadsieve.functions import keywords as kw
from leadsieve.functions.decide import decide
from leadsieve.functions.pages import is_parked_text, PARKED_PHRASES
from leadsieve.functions.prompts import build_prompt
from pyspark.sql import functions as F

LISTS = {"primary": ["Pump", "well"], "secondary": ["tank", "drain"], "negative": ["food"]}


def config(lists=LISTS, **rules):
    return SieveConfig.from_mapping({"industry_keywords": lists, "keyword_match_rules": rules})


# text, config, (result, matched, negatives)
CASES = [
    (None, config(), ("no_text", [], [])),
    ("", config(), ("no_text", [], [])),
    ("PUMPs and tankless FOOD", config(), ("negative_match", [], ["food"])),
    ("PUMPs and tanks, drain", config(), ("match", ["Pump"], [])),
    ("WELL pump", config(), ("match", ["Pump", "well"], [])),
    ("tankless drains", config(), ("match", ["tank", "drain"], [])),
    ("a tank", config(), ("weak_match", ["tank"], [])),
    ("nothing", config(), ("no_match", [], [])),
    ("pump tank", config(primary_threshold=2), ("weak_match", ["Pump", "tank"], [])),
    ("pump tank drain", config(primary_threshold=2), ("match", ["Pump", "tank", "drain"], [])),
    ("food pump", config(negative_override=False), ("match", ["Pump"], ["food"])),
    ("food", config(negative_override=False), ("no_match", [], ["food"])),
    ("x", config({**LISTS, "primary": []}, primary_threshold=0), ("match", [], [])),
    ("tank", config({**LISTS, "secondary": ["tank", "tank"]}), ("match", ["tank", "tank"], [])),
    ("tank", config({"primary": None, "secondary": ["tank"]}), ("weak_match", ["tank"], [])),
]


@pytest.mark.parametrize("unroll", [60, 0])
def test_match(spark, monkeypatch, unroll):
    monkeypatch.setattr(kw, "UNROLL_TERMS", unroll)
    for text, cfg, want in CASES:
        frame = spark.createDataFrame([(text,)], "text string").withColumn("low", F.lower("text"))
        row = kw.with_keyword_match(frame, "text", "low", cfg).first()
        assert (row.match_result, row.matched, row.negatives) == want, text


def test_parse_keywords(evaluate):
    cases = {
        None: [],
        "": [],
        " ,\n ,": [],
        "Septic, WASTE water\n\npump,": ["septic", "waste water", "pump"],
        " a ,﻿b": ["a", "b"],
        "\u0085c": ["\u0085c"],
    }
    assert evaluate(kw.parse_keywords, list(cases)) == list(cases.values())


def test_effective_keywords(spark):
    own = SieveConfig().with_keywords(["p"], ["s"], ["n"])
    rows = [([], [], ["x"]), (["a"], [], []), ([], ["b"], ["x"])]
    frame = spark.createDataFrame(rows, "p array<string>, s array<string>, n array<string>")
    got = [tuple(r) for r in kw.with_effective_keywords(frame, "p", "s", "n", own).collect()]
    assert got == [
        (["p"], ["s"], ["n"]),
        (["a"], ["tank", "drain", "cleanout"], []),
        (["septic", "wastewater", "pumping"], ["b"], ["x"]),
    ]


def test_parked(evaluate):
    filler = "plain words " * 10
    parked = [None, "", "x" * 99, " " * 90 + "x" * 50, filler + PARKED_PHRASES[0].upper()]
    fine = ["x" * 100, filler, filler + "under  construction"]
    run = lambda v: is_parked_text(v, F.lower(v))
    assert evaluate(run, parked) == [True] * len(parked)
    assert evaluate(run, fine) == [False] * len(fine)
    assert all(evaluate(run, [filler + p for p in PARKED_PHRASES]))


DECISIONS = {
    ("dead", "match"): ("FAIL", "Domain: dead"),
    ("timeout", None): ("FAIL", "Domain: timeout"),
    ("ssl_error", "x"): ("FAIL", "Domain: ssl_error"),
    ("invalid_domain", "skipped"): ("FAIL", "Domain: invalid_domain"),
    ("not_found", "x"): ("FAIL", "Domain: not_found"),
    ("server_error", "x"): ("FAIL", "Domain: server_error"),
    ("error", "x"): ("FAIL", "Domain: error"),
    ("redirects_to_social", "x"): ("FAIL", "Domain: redirects_to_social"),
    ("parked", "parked_domain"): ("FAIL", "Parked/dead domain"),
    ("live", "negative_match"): ("FAIL", "Negative keyword match: n1; n2"),
    ("live", "no_match"): ("FAIL", "No industry keyword matches on homepage"),
    ("needs_get", "match"): ("PASS", "Keywords: m1; m2"),
    ("live", "weak_match"): ("REVIEW", "Weak match: m1; m2"),
    ("live", "no_text"): ("REVIEW", "Could not extract text: no_text"),
    ("live", "error"): ("REVIEW", "Could not extract text: error"),
    ("live", "skipped"): ("REVIEW", "Could not extract text: skipped"),
    ("http_429", "domain_dead"): ("REVIEW", "Unclassified: http_429/domain_dead"),
    ("live", "not_run"): ("REVIEW", "Unclassified: live/not_run"),
    (None, None): ("REVIEW", "Unclassified: unknown/unknown"),
}


def test_decisions(spark):
    frame = spark.createDataFrame(list(DECISIONS), "s string, m string")
    verdict = decide(F.col("s"), F.col("m"), F.lit("m1; m2"), F.lit("n1; n2"))
    got = {(r.s, r.m): tuple(r.v) for r in frame.select("s", "m", verdict.alias("v")).collect()}
    assert got == DECISIONS


def test_prompt(spark):
    rows = [("text {x} $1", "mine \\ {y}"), ("", None)]
    frame = spark.createDataFrame(rows, "t string, c string")
    full, bare = [r.p for r in frame.select(build_prompt(F.col("t"), F.col("c")).alias("p")).collect()]
    assert "BUY-BOX CRITERIA:\nmine \\ {y}\n" in full and "key pages):\ntext {x} $1\n" in full
    assert "(no text scraped)" in bare and "exclude negative keywords." in bare


def test_lists_of_hundreds_of_terms(spark):
    rng = random.Random(4)
    alphabet = "abcd é"
    texts = [None, "", "abc", *("".join(rng.choices(alphabet, k=rng.randint(1, 400))) for _ in range(60))]
    terms = ["".join(rng.choices(alphabet, k=rng.randint(1, 9))).strip() or "a" for _ in range(500)]
    docs = spark.createDataFrame([(i, t, i % 2) for i, t in enumerate(texts)], "id long, text string, campaign_id long")
    lists = [(0, ",".join(terms), "a,b", ""), (1, "abc", ",".join(terms), ",".join(terms))]
    campaigns = spark.createDataFrame(lists, "campaign_id long, primary string, secondary string, negative string")
    cfg = SieveConfig.from_mapping({"industry_keywords": LISTS, "keyword_match_rules": {"negative_override": False}})
    got = {r.id: r for r in kw.with_campaign_match(docs, campaigns, "text", cfg).collect()}
    typed = [t.strip() for t in terms if t.strip()]
    for i, text in enumerate(texts):
        hits = [t for t in typed if t in (text or "").lower()]
        if not text:
            assert got[i].match_result == "no_text"
        elif i % 2:
            assert got[i].negatives == hits
        elif hits:
            assert got[i].matched == hits


def test_campaigns_that_share_an_id_are_refused(spark):
    docs = spark.createDataFrame([(1, "pump", 7), (2, "pump", None)], "id long, text string, campaign_id long")
    rows = [(7, "pump", "", ""), (8, "x", "", ""), (None, "pump", "", ""), (None, "y", "", "")]
    schema = "campaign_id long, primary string, secondary string, negative string"
    found = kw.with_campaign_match(docs, spark.createDataFrame(rows, schema), "text", config()).collect()
    assert sorted((r.id, r.match_result) for r in found) == [(1, "match"), (2, "match")]
    twice = spark.createDataFrame([*rows, (7, "tank", "", "")], schema)
    with pytest.raises(Exception, match="several campaigns with campaign_id 7"):
        kw.with_campaign_match(docs, twice, "text", config()).collect()

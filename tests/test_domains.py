import pytest

from leadsieve.functions.domains import SOCIAL_HOSTS, is_social, url_host, with_normalized_url
from pyspark.sql import functions as F

CASES = {
    " HTTPS://WWW.Example.com/a?b#c ": "https://example.com",
    "//www.example.com": "https://example.com",
    "septic": "https://septic.com",
    "http://septic": "https://septic.com",
    "https://www": None,
    "http": None,
    "example.com:8080": "https://example.com:8080",
    "www.www.a.com": "https://www.a.com",
    "ftp://a.com": None,
    "foo bar.com": "https://foo bar.com",
    "foo bar": None,
    "netflix.com": None,
    "fedex.com": None,
    "google.com/maps": "https://google.com",
    "maps.google.com": None,
    "https://facebook.com/page": None,
    "a.com/x y": "https://a.com",
    " a.com　": "https://a.com",
    "-dash": None,
    "a" * 63: "https://" + "a" * 63 + ".com",
    "a" * 64: None,
    "?q=1": None,
    "": None,
    "   ": None,
    None: None,
}


def test_normalize_domain(spark):
    frame = spark.createDataFrame([(k, v) for k, v in CASES.items()], "typed string, want string")
    rows = with_normalized_url(frame, F.col("typed"), "got").collect()
    assert [(r.typed, r.got) for r in rows] == [(r.typed, r.want) for r in rows]


@pytest.mark.parametrize("host", SOCIAL_HOSTS)
def test_social_hosts_match_as_substrings(evaluate, host):
    assert evaluate(is_social, [f"my{host}.au", host[1:]]) == [True, False]


def test_url_host(evaluate):
    cases = {
        "https://www.a.www.b.com/x": "a.b.com",
        "http://A.com:80?x": "A.com:80",
        "//b.org/p": "b.org",
        "no-scheme.com/x": "",
        "": "",
        None: None,
    }
    assert evaluate(url_host, list(cases)) == list(cases.values())

from pyspark.sql import functions as F

from leadsieve.operators.probes import live_summary, pivot_probes, with_verdict

URL = "https://a.com"
LOG = "url string, attempt string, status_code int, final_url string, error_kind string, error_text string"


def head(status=None, final=URL, kind=None, text=None):
    return ("head_https", status, final if status else None, kind, text)


def get(status=None, final="https://a.com/get"):
    return ("get", status, final if status else None, None if status else "other", None)


def plain(status=None, final="http://b.com"):
    return ("head_http", status, final if status else None, None if status else "connect", None)


SSL = head(kind="ssl")
# name: (answers, (domain_status, http_code, redirect_url, error))
CASES = {
    "ok": ([head(200)], ("live", 200, None, None)),
    "same host but for www": ([head(200, "https://www.a.com/x")], ("live", 200, None, None)),
    "other host": ([head(200, "https://b.com/x")], ("live", 200, "https://b.com/x", None)),
    "no content": ([head(204)], ("http_204", 204, None, None)),
    "moved": ([head(301)], ("redirect", 301, None, None)),
    "permanent": ([head(308)], ("redirect", 308, None, None)),
    "304 is no redirect": ([head(304)], ("http_304", 304, None, None)),
    "social": (
        [head(403, "https://m.facebook.com/x"), get(200)],
        ("redirects_to_social", 403, "https://m.facebook.com/x", None),
    ),
    "blocked, page ok": ([head(403), get(200)], ("live", 200, "https://a.com/get", None)),
    "blocked, page moved": ([head(405), get(302)], ("redirect", 302, "https://a.com/get", None)),
    "blocked, page ok without address": (
        [head(403, "https://b.com"), ("get", 200, None, None, None)],
        ("live", 200, "https://b.com", None),
    ),
    "blocked twice": ([head(403, "https://b.com"), get(403)], ("needs_get", 403, "https://b.com", None)),
    "blocked, page failed": ([head(405), get()], ("needs_get", 405, None, None)),
    "missing": ([head(404), get(200)], ("not_found", 404, None, None)),
    "server": ([head(500), get(200)], ("server_error", 500, None, None)),
    "busy": ([head(429)], ("http_429", 429, None, None)),
    "tls, plain ok": ([SSL, plain(200), get(200)], ("live_http_only", 200, None, None)),
    "tls, plain 403": ([SSL, plain(403), get(200)], ("http_403", 403, None, None)),
    "tls, page ok": ([SSL, plain(), get(200)], ("live_http_only", 200, "https://a.com/get", None)),
    "tls, page moved": (
        [SSL, plain(), get(301)],
        ("ssl_error", None, None, "SSL error and HTTP fallback failed"),
    ),
    "tls, nothing": ([SSL, plain()], ("ssl_error", None, None, "SSL error and HTTP fallback failed")),
    "refused": (
        [head(kind="connect"), get()],
        ("dead", None, None, "Connection refused or DNS failure"),
    ),
    "refused, page 500": (
        [head(kind="connect"), get(500)],
        ("dead", 500, None, "Connection refused or DNS failure"),
    ),
    "refused, page ok": ([head(kind="connect"), get(200)], ("live", 200, "https://a.com/get", None)),
    "connect timeout": (
        [head(kind="connect_timeout")],
        ("dead", None, None, "Connection refused or DNS failure"),
    ),
    "read timeout": ([head(kind="read_timeout"), get()], ("timeout", None, None, "No response within 7s")),
    "other": ([head(kind="other", text="x" * 300)], ("error", None, None, "x" * 200)),
    "other, page moved": (
        [head(kind="other", text="x"), get(307)],
        ("redirect", 307, "https://a.com/get", None),
    ),
    "never probed": ([get(200)], ("unknown", None, None, None)),
}


def test_decision_table(spark):
    names = list(CASES)
    rows = [(f"{URL}?{n}", *a) for n in names for a in CASES[n][0]]
    log = spark.createDataFrame(rows, LOG)
    done = {r.url.split("?")[1]: r["_probe"] for r in with_verdict(pivot_probes(log), 7).collect()}
    got = {n: tuple(done[n][f] for f in ("domain_status", "http_code", "redirect_url", "error")) for n in names}
    assert got == {n: CASES[n][1] for n in names}
    assert not any(v["is_parked"] for v in done.values())


def test_url_without_probe_or_address(spark):
    answer = "struct<status_code:int,final_url:string,error_kind:string,error_text:string>"
    frame = spark.createDataFrame(
        [("https://a.com", None), (None, None)], f"url string, head {answer}"
    )
    frame = frame.withColumn("head_http", F.col("head")).withColumn("get", F.col("head"))
    got = {r.url: r["_probe"]["domain_status"] for r in with_verdict(frame, 10).collect()}
    assert got == {"https://a.com": "unknown", None: "invalid_domain"}


def test_repeated_answers_do_not_depend_on_order(spark):
    rows = [("u", "head_https", 503, "u", None, None), ("u", "head_https", None, None, "connect", None)]
    for order in (rows, rows[::-1]):
        row = pivot_probes(spark.createDataFrame(order, LOG)).collect()[0]
        assert row["head"]["status_code"] == 503
    timed = spark.createDataFrame(
        [(*rows[0], "2024-01-01"), (*rows[1], "2024-01-02")], LOG + ", probed_at string"
    )
    assert pivot_probes(timed).collect()[0]["head"]["error_kind"] == "connect"


def test_live_summary(spark):
    frame = spark.createDataFrame(
        [("live",), ("needs_get",), ("dead",), (None,)], "domain_status string"
    )
    assert tuple(live_summary(frame).first()) == (2, 4, 50.0)
    assert tuple(live_summary(frame.limit(0)).first()) == (0, 0, None)

"""What the recorded answers of a domain probe say about the domain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadsieve.functions.domains import is_social, url_host
from leadsieve.functions.text import left, nz

# Status names and code groups of the decision table.
LIVE_STATUSES = ("live", "live_http_only", "redirect", "needs_get")
REDIRECT_CODES = (301, 302, 303, 307, 308)
BLOCKED_CODES = (403, 405)
DEAD_ERRORS = ("connect", "connect_timeout")
MAX_ERROR_TEXT = 200

# Messages.
CONNECT_MESSAGE = "Connection refused or DNS failure"
SSL_MESSAGE = "SSL error and HTTP fallback failed"


def is_live(status: Column) -> Column:
    return F.coalesce(status.isin(*LIVE_STATUSES), F.lit(False))


def _http(code: Column) -> Column:
    return F.concat(F.lit("http_"), code.cast("string"))


def head_outcome(url: Column, head: Column) -> Column:
    """What the first request alone says: its status name, or null if never sent."""
    code, error = head["status_code"], head["error_kind"]
    elsewhere = url_host(nz(head["final_url"])) != url_host(url)
    social = elsewhere & is_social(url_host(head["final_url"]))
    return (
        F.when(
            code.isNotNull(),
            F.when(social, "redirects_to_social")
            .when(code == 200, "live")
            .when(code.isin(*REDIRECT_CODES), "redirect")
            .when(code.isin(*BLOCKED_CODES), "needs_get")
            .when(code == 404, "not_found")
            .when(code >= 500, "server_error")
            .otherwise(_http(code)),
        )
        .when(error == "ssl", "ssl_error")
        .when(error.isin(*DEAD_ERRORS), "dead")
        .when(error == "read_timeout", "timeout")
        .when(head.isNotNull(), "error")
    )


def settle_probe(
    url: Column, outcome: Column, head: Column, head_http: Column, get: Column, timeout: int
) -> Column:
    """Final verdict of a URL as ``(domain_status, http_code, redirect_url, is_parked, error)``.

    ``outcome`` is ``head_outcome`` held in a column. ``get`` is the answer of the
    page request, which counts only where the first request left the matter open:
    after a TLS failure when plain HTTP did not answer either, and after a
    blocked, refused, timed-out or failed first request.
    """
    elsewhere = url_host(nz(head["final_url"])) != url_host(url)
    moved = F.when(elsewhere, head["final_url"])
    plain = head_http["status_code"]
    ssl = outcome == "ssl_error"
    open_case = outcome.isin("needs_get", "dead", "timeout", "error")
    fetched = get["status_code"] == 200
    forwarded = get["status_code"].isin(*REDIRECT_CODES)

    status = (
        F.when(url.isNull(), "invalid_domain")
        .when(outcome.isNull(), "unknown")
        .when(ssl & (plain == 200), "live_http_only")
        .when(ssl & plain.isNotNull(), _http(plain))
        .when(ssl & fetched, "live_http_only")
        .when(open_case & fetched, "live")
        .when(open_case & forwarded, "redirect")
        .otherwise(outcome)
    )
    http_code = (
        F.when(ssl, F.coalesce(plain, F.when(fetched, F.lit(200))))
        .when(open_case & (fetched | forwarded), get["status_code"])
        .when(open_case, F.coalesce(head["status_code"], get["status_code"]))
        .otherwise(head["status_code"])
    )
    redirect_url = (
        F.when(ssl, F.when(plain.isNull() & fetched, nz(get["final_url"])))
        .when(open_case & (fetched | forwarded), F.coalesce(nz(get["final_url"]), moved))
        .otherwise(moved)
    )
    settled = fetched | forwarded
    error = (
        F.when(ssl & plain.isNull() & ~F.coalesce(fetched, F.lit(False)), SSL_MESSAGE)
        .when(~open_case | F.coalesce(settled, F.lit(False)), F.lit(None))
        .when(outcome == "dead", CONNECT_MESSAGE)
        .when(outcome == "timeout", f"No response within {timeout}s")
        .when(outcome == "error", left(head["error_text"], MAX_ERROR_TEXT))
    )
    return F.struct(
        status.alias("domain_status"),
        http_code.cast("int").alias("http_code"),
        redirect_url.alias("redirect_url"),
        F.lit(False).alias("is_parked"),
        error.alias("error"),
    )

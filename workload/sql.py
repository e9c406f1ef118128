"""The registered queries as DuckDB SQL, written from the definitions alone.

RE2 has no look-around and its ``\\s`` and ``\\b`` are ASCII, so white space is spelled out
and accented letters are fenced with ``_`` while legal forms are removed.
"""

from __future__ import annotations

from leadsieve.config import DEFAULT_SCRAPE_PATHS
from leadsieve.functions.decide import FAILED_STATUSES
from leadsieve.functions.domains import NOT_A_HOST, SOCIAL_HOSTS
from leadsieve.functions.keywords import REQUEST_PRIMARY, REQUEST_SECONDARY
from leadsieve.functions.names import ACRONYMS, GENERIC_SEGMENTS, LEGAL_FORMS, SMALL_WORDS
from leadsieve.functions.pages import PARKED_PHRASES
from leadsieve.functions.prompts import NO_CRITERIA, NO_TEXT, PROMPT
from workload.derive import (
    KEYWORDS,
    MARKUP,
    NEGATIVE_MARKUP,
    OLD_MARKUP,
    PARKED_MARKUP,
    PROBE_CASES,
    PROBE_KINDS,
    SLOT_PATHS,
)
from workload.spark_queries import (
    CAMPAIGN_NEGATIVE,
    CAMPAIGN_PRIMARY,
    CAMPAIGN_SECONDARY,
    CAMPAIGNS,
    CSV_FILES,
    MATCHES,
    NAME_ENDINGS,
    STATUSES,
)

WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def q(text) -> str:
    """A SQL literal."""
    if text is None:
        return "NULL"
    return "'" + str(text).replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{WS}+', ''), '{WS}+$', '')"


def any_of(x: str, needles) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(n)})" for n in needles) + ")"


def in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def choose(n: str, values) -> str:
    cases = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"(CASE ({n}) % {len(values)} {cases} END)"


def struct_list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


# ---- derived inputs -------------------------------------------------------------------

CRAWL = """
crawl AS (
  SELECT page_id * 2 AS row_id, page_id AS id, page_id // 4 AS site_no,
         CAST(page_id % 4 AS INTEGER) AS slot,
         'p' || (page_id // 4) || '.example.org' AS host, html
  FROM pages
  UNION ALL
  SELECT doc_id * 2 + 1, doc_id, doc_id // 4, CAST(doc_id % 4 AS INTEGER),
         'd' || (doc_id // 4) || '.example.net',
         '<html><head><title>' || lang || ' ' || source || ' Co-op | Home</title></head><body><p>'
           || text || '</p></body></html>'
  FROM documents)"""

MARKED = f"""
marked AS (
  SELECT * EXCLUDE (html),
         CASE WHEN slot = 0 THEN
           {choose("site_no", [q(m) for m in MARKUP])}
           || CASE WHEN site_no % 11 = 5 THEN {q(PARKED_MARKUP)} ELSE '' END
           || CASE WHEN site_no % 17 = 0 THEN {q(NEGATIVE_MARKUP)} ELSE '' END
           || html
         ELSE html END AS html
  FROM crawl)"""

LEADS = f"""
leads AS (
  SELECT row_id,
         {choose("id", ["''", "'Company ' || row_id || ' LLC'", "'ACME ' || row_id",
                        "'co ' || row_id || ' inc'"])} AS company_name,
         CASE id % 10
           WHEN 0 THEN '' WHEN 1 THEN 'lead' || row_id
           WHEN 2 THEN 'https://facebook.com/lead' || row_id
           WHEN 3 THEN '//www.' || host
           WHEN 4 THEN ' HTTPS://WWW.' || upper(host) || '/a?b#c '
           WHEN 5 THEN NULL WHEN 6 THEN host
           ELSE 'http://' || host || '/p/' || row_id || '?utm_source=feed' END AS domain,
         CASE WHEN id % 10 = 0 THEN 'https://www.' || host || '/x' ELSE '' END AS website
  FROM crawl)"""


def host_sql(x: str) -> str:
    x = f"lower({strip(x)})"
    for cut in ("^https?://", "^//+", "[/?#].*$", r"^www\."):
        x = f"regexp_replace({x}, '{cut}', '')"
    return strip(x)


def url_sql(host: str) -> str:
    return f"""CASE WHEN {host} IS NULL OR {host} = '' OR {any_of(host, SOCIAL_HOSTS)} THEN NULL
      WHEN contains({host}, '.') THEN 'https://' || {host}
      WHEN {host} IN {in_list(NOT_A_HOST)} THEN NULL
      WHEN regexp_full_match({host}, '[a-z0-9][-a-z0-9]{{0,62}}') THEN 'https://' || {host} || '.com'
      END"""


ROWS = f"""
hosted AS (
  SELECT *, coalesce(nullif(company_name, ''), '') AS raw_name,
         {host_sql("coalesce(nullif(domain, ''), nullif(website, ''))")} AS bare
  FROM leads),
lead_rows AS (SELECT * EXCLUDE (bare), {url_sql("bare")} AS url FROM hosted)"""

_CASES = ",\n    ".join(
    f"({n}, {q(a)}, {'NULL' if s is None else s}, {q(f)}, {q(k)}, {q(t)})"
    for n, a, s, f, k, t in PROBE_CASES
)
LOG = f"""
probe_cases(n, attempt, status_code, final_kind, error_kind, error_text) AS (
  VALUES {_CASES}),
lead_urls AS (
  SELECT url, min(row_id) AS first_row FROM lead_rows WHERE url IS NOT NULL GROUP BY url),
answers AS (
  SELECT u.url, c.attempt, c.status_code, c.error_kind, c.error_text,
         CASE c.final_kind WHEN 'same' THEN u.url
           WHEN 'www' THEN replace(u.url, 'https://', 'https://www.')
           WHEN 'other' THEN 'https://elsewhere.example.com/home'
           WHEN 'social' THEN replace(u.url, 'https://', 'https://www.facebook.com/')
           WHEN 'page' THEN u.url || '/page' END AS final_url
  FROM lead_urls u JOIN probe_cases c ON c.n = (u.first_row // 8) % {PROBE_KINDS})"""


def net(x: str) -> str:
    return f"replace(regexp_extract({x}, '^[a-z]+://([^/?#]*)', 1), 'www.', '')"


VERDICTS = f"""
head AS (
  SELECT url, status_code AS code, final_url, error_kind, error_text,
         {net("final_url")} <> {net("url")} AS moved,
         {any_of(net("final_url"), SOCIAL_HOSTS)} AS social
  FROM answers WHERE attempt = 'head_https'),
first_look AS (
  SELECT h.*, p.status_code AS plain, g.status_code AS get_code, g.final_url AS get_url,
         CASE WHEN code IS NULL THEN
                CASE h.error_kind WHEN 'ssl' THEN 'ssl' WHEN 'connect' THEN 'dead'
                  WHEN 'connect_timeout' THEN 'dead' WHEN 'read_timeout' THEN 'timeout'
                  ELSE 'error' END
              WHEN moved AND social THEN 'redirects_to_social'
              WHEN code = 200 THEN 'live'
              WHEN code IN (301, 302, 303, 307, 308) THEN 'redirect'
              WHEN code IN (403, 405) THEN 'needs_get'
              WHEN code = 404 THEN 'not_found'
              WHEN code >= 500 THEN 'server_error'
              ELSE 'http_' || code END AS look
  FROM head h
  LEFT JOIN answers p ON p.url = h.url AND p.attempt = 'head_http'
  LEFT JOIN answers g ON g.url = h.url AND g.attempt = 'get'),
looked AS (
  SELECT *, look IN ('dead', 'timeout', 'error', 'needs_get') AS try_get,
         coalesce(get_code = 200, false) AS got,
         coalesce(get_code IN (301, 302, 303, 307, 308), false) AS sent_on
  FROM first_look),
verdicts AS (
  SELECT url,
    CASE WHEN look = 'ssl' AND plain IS NOT NULL
           THEN CASE WHEN plain = 200 THEN 'live_http_only' ELSE 'http_' || plain END
         WHEN look = 'ssl' THEN CASE WHEN got THEN 'live_http_only' ELSE 'ssl_error' END
         WHEN try_get AND got THEN 'live'
         WHEN try_get AND sent_on THEN 'redirect'
         ELSE look END AS domain_status,
    CAST(CASE WHEN look = 'ssl' THEN coalesce(plain, CASE WHEN got THEN 200 END)
         WHEN try_get AND (got OR sent_on) THEN get_code
         WHEN try_get THEN coalesce(code, get_code)
         ELSE code END AS INTEGER) AS http_code,
    CASE WHEN look = 'ssl' THEN CASE WHEN plain IS NULL AND got THEN get_url END
         WHEN try_get AND (got OR sent_on) THEN get_url
         WHEN moved THEN final_url END AS redirect_url,
    false AS is_parked,
    CASE WHEN look = 'ssl' AND plain IS NULL AND NOT got THEN 'SSL error and HTTP fallback failed'
         WHEN got OR sent_on THEN NULL
         WHEN look = 'dead' THEN 'Connection refused or DNS failure'
         WHEN look = 'timeout' THEN 'No response within 10s'
         WHEN look = 'error' THEN left(error_text, 200) END AS error
  FROM looked)"""

_PATH = choose("slot", [q(p) for p in SLOT_PATHS])
SNAPSHOT = f"""
snapshot AS (
  SELECT 'https://' || host || {_PATH} || CASE WHEN slot = 0 AND site_no % 5 > 2 THEN '/' ELSE '' END AS url,
         CASE WHEN site_no % 13 = 12 AND slot = 0 THEN 404 ELSE 200 END AS status_code,
         html,
         CASE WHEN site_no % 3 = 0 OR (site_no % 3 = 1 AND slot > 0) THEN 'api'
              ELSE 'direct' END AS fetch_via,
         TIMESTAMP '2024-02-01' AS captured_at
  FROM marked
  UNION ALL
  SELECT 'https://' || host || {_PATH} || CASE WHEN slot = 0 AND site_no % 5 > 3 THEN '/' ELSE '' END,
         200, {q(OLD_MARKUP)} || html,
         CASE WHEN site_no % 3 = 0 OR (site_no % 3 = 1 AND slot > 0) THEN 'api'
              ELSE 'direct' END,
         TIMESTAMP '2024-01-01'
  FROM marked)"""


# ---- page expressions ------------------------------------------------------------------


def text_sql(html: str) -> str:
    x = html
    for pattern in ("(?is)<script[^>]*>.*?</script>", "(?is)<style[^>]*>.*?</style>", "<[^>]+>"):
        x = f"regexp_replace({x}, '{pattern}', ' ', 'g')"
    for entity, char in (
        ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&#39;", "'"), ("&quot;", '"'),
    ):
        x = f"replace({x}, {q(entity)}, {q(char)})"
    x = f"regexp_replace({x}, '{WS}+', ' ', 'g')"
    return strip(x)


def parked_sql(text: str) -> str:
    return (
        f"({text} IS NULL OR {text} = '' OR length({strip(text)}) < 100"
        f" OR {any_of(f'lower({text})', PARKED_PHRASES)})"
    )


def segments(title: str) -> str:
    return (
        f"list_transform(regexp_split_to_array({title}, '{WS}*[|–—:\\-]{WS}*'),"
        f" lambda s: {strip('s')})"
    )


def clean_sql(x: str) -> str:
    """The cleaned name before case is mended."""
    for entity, char in (("&amp;", "&"), ("&#39;", "'"), ("&quot;", '"'), ("&#x27;", "'"), ("&apos;", "'")):
        x = f"replace({x}, {q(entity)}, {q(char)})"
    x = f"regexp_replace({x}, '([^\\x00-\\x7f])', '_\\x02\\1\\x02_', 'g')".replace(
        "'_\\x02\\1\\x02_'", "'_' || chr(2) || '\\1' || chr(2) || '_'"
    )
    for form in LEGAL_FORMS:
        pattern = form.replace("{b}", r"\b")
        x = f"regexp_replace({x}, '(?i),?{WS}*{pattern}', '', 'g')"
    x = f"replace(replace({x}, '_' || chr(2), ''), chr(2) || '_', '')"
    return strip(f"regexp_replace({x}, '({WS}|[,.|\\-])+$', '')")


def capital(w: str) -> str:
    return (
        f"(CASE WHEN starts_with({w}, 'ß') THEN 'Ss' || lower(substr({w}, 2))"
        f" ELSE upper(left({w}, 1)) || lower(substr({w}, 2)) END)"
    )


def word_case(w: str) -> str:
    return (
        f"(CASE WHEN upper({w}) IN {in_list(ACRONYMS)} THEN upper({w})"
        f" WHEN lower({w}) IN {in_list(SMALL_WORDS)} THEN lower({w}) ELSE {capital(w)} END)"
    )


def cased_sql(name: str) -> str:
    upper = f"regexp_matches({name}, '\\p{{Lu}}')"
    lower = f"regexp_matches({name}, '\\p{{Ll}}')"
    words = f"regexp_split_to_array({name}, '{WS}+')"
    mended = f"list_transform({words}, lambda w: {word_case('w')})"
    return (
        f"CASE WHEN {upper} <> {lower} THEN array_to_string(list_prepend({capital(f'({mended})[1]')},"
        f" ({mended})[2:]), ' ') ELSE {name} END"
    )


def named(source: str, html: str, out: str) -> str:
    """CTEs that add ``site_name`` and ``name_source`` to relation ``source``."""

    def meta(prop: str) -> str:
        one = f"""(?i)<meta[^>]*property=["'']{prop}["''][^>]*content=["'']([^"'']+)["'']"""
        two = f"""(?i)<meta[^>]*content=["'']([^"'']+)["''][^>]*property=["'']{prop}["'']"""
        return strip(
            f"coalesce(nullif(regexp_extract({html}, '{one}', 1), ''), "
            f"regexp_extract({html}, '{two}', 1))"
        )

    title = strip(f"regexp_extract({html}, '(?i)<title[^>]*>([^<]+)</title>', 1)")
    stated = strip(f"""regexp_extract({html}, '"name"{WS}*:{WS}*"([^"]{{2,80}})"', 1)""")
    good = f"lower(s) NOT IN {in_list(GENERIC_SEGMENTS)} AND length(s) > 1 AND length(s) < 60"
    return f"""
{out}_found AS (
  SELECT *, {meta("og:site_name")} AS f_site,
         list_filter({segments(title)}, lambda s: {good})[1] AS f_title,
         list_filter({segments(meta("og:title"))}, lambda s: length(s) > 1)[1] AS f_og,
         {stated} AS f_json
  FROM {source}),
{out}_picked AS (
  SELECT * EXCLUDE (f_site, f_title, f_og, f_json),
         CASE WHEN {html} IS NULL OR {html} = '' THEN {{'n': NULL, 's': 'no_html'}}
              WHEN f_site <> '' AND length(f_site) < 100 THEN {{'n': f_site, 's': 'og:site_name'}}
              WHEN f_title IS NOT NULL THEN {{'n': f_title, 's': 'title_tag'}}
              WHEN length(f_og) < 60 THEN {{'n': f_og, 's': 'og:title'}}
              WHEN len(regexp_split_to_array(f_json, '{WS}+')) BETWEEN 2 AND 8
                THEN {{'n': f_json, 's': 'schema_org'}}
              ELSE {{'n': NULL, 's': 'fallback'}} END AS pick
  FROM {out}_found),
{out}_bare AS (SELECT *, {clean_sql("pick.n")} AS bare FROM {out}_picked),
{out} AS (
  SELECT * EXCLUDE (pick, bare), {cased_sql("bare")} AS site_name, pick.s AS name_source
  FROM {out}_bare)"""


def hits(low: str, keywords) -> str:
    return f"list_filter({struct_list(keywords)}, lambda k: contains({low}, lower(k)))"


def matching(source: str, text: str, out: str, keywords, primary=1, secondary=2, override=True, tag=""):
    """CTEs that add ``{tag}result, {tag}matched, {tag}negatives`` (strings)."""
    ruled_out = "len(k_neg) > 0" if override else "false"
    return f"""
{out}_hits AS (
  SELECT *, {hits(f"lower({text})", keywords["primary"])} AS k_pri,
         {hits(f"lower({text})", keywords["secondary"])} AS k_sec,
         {hits(f"lower({text})", keywords["negative"])} AS k_neg
  FROM {source}),
{out} AS (
  SELECT * EXCLUDE (k_pri, k_sec, k_neg),
    CASE WHEN {text} IS NULL OR {text} = '' THEN 'no_text'
         WHEN {ruled_out} THEN 'negative_match'
         WHEN len(k_pri) >= {primary} OR len(k_sec) >= {secondary} THEN 'match'
         WHEN len(k_pri) + len(k_sec) > 0 THEN 'weak_match'
         ELSE 'no_match' END AS {tag}result,
    CASE WHEN {text} IS NULL OR {text} = '' OR {ruled_out} THEN ''
         WHEN len(k_pri) >= {primary} THEN array_to_string(k_pri, '; ')
         ELSE array_to_string(k_pri || k_sec, '; ') END AS {tag}matched,
    CASE WHEN {text} IS NULL OR {text} = '' THEN ''
         ELSE array_to_string(k_neg, '; ') END AS {tag}negatives
  FROM {out}_hits)"""


def latest(use_api: bool) -> str:
    """CTEs ``texts`` (latest capture per URL and origin, with text)."""
    return f"""
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY url, fetch_via ORDER BY captured_at DESC) AS rn
  FROM (SELECT * REPLACE (regexp_replace(url, '^(https://[^/]*)/$', '\\1') AS url) FROM snapshot)),
texts AS (
  SELECT url, fetch_via, CASE WHEN status_code = 200 THEN html END AS page,
         CASE WHEN status_code = 200 THEN nullif({text_sql("html")}, '') END AS text
  FROM ranked WHERE rn = 1)"""


def site_facts(use_api: bool) -> str:
    sub_via = "api" if use_api else "direct"
    pick = (
        "CASE WHEN a.text IS NOT NULL THEN a.{c} ELSE d.{c} END" if use_api else "d.{c}"
    )
    sub_paths = SLOT_PATHS[1:]
    subs = "\n  ".join(
        f"LEFT JOIN texts s{i} ON s{i}.url = s.site || {q(p)} AND s{i}.fetch_via = '{sub_via}'"
        for i, p in enumerate(sub_paths)
    )
    sub_cols = ", ".join(
        f"CASE WHEN length({strip(f's{i}.text')}) > 150 THEN s{i}.text END AS sub{i}"
        for i in range(len(sub_paths))
    )
    labels = [p.strip("/").upper().replace("-", " ") for p in sub_paths]
    parts = " || ".join(
        f"CASE WHEN follow AND sub{i} IS NOT NULL THEN chr(10) || chr(10) || '=== {label} PAGE ==='"
        f" || chr(10) || left(sub{i}, 2500) ELSE '' END"
        for i, label in enumerate(labels)
    )
    pages = " || ".join(
        f"CASE WHEN follow AND sub{i} IS NOT NULL THEN ';{p}' ELSE '' END"
        for i, p in enumerate(sub_paths)
    )
    return f"""{latest(use_api)},
seen_sites AS (
  SELECT DISTINCT regexp_extract(url, '^https://[^/]*') AS site FROM snapshot
  WHERE fetch_via = '{sub_via}'{" OR regexp_full_match(url, 'https://[^/]*/?')" if use_api else ""}),
homes AS (
  SELECT s.site, {pick.format(c="text")} AS text, {pick.format(c="page")} AS page, {sub_cols}
  FROM seen_sites s
  LEFT JOIN texts d ON d.url = s.site AND d.fetch_via = 'direct'
  LEFT JOIN texts a ON a.url = s.site AND a.fetch_via = 'api'
  {subs}),{named("homes", "page", "named")},{matching("named", "text", "tagged", KEYWORDS)},
sorted AS (
  SELECT *, {parked_sql("text")} AS parked, result IN ('match', 'weak_match') AS follow
  FROM tagged),
facts AS (
  SELECT site AS url,
    CASE WHEN parked THEN 'parked_domain' ELSE result END AS industry_match,
    CASE WHEN parked THEN '' ELSE matched END AS matched_keywords,
    CASE WHEN NOT parked THEN negatives END AS negative_keywords,
    coalesce(left(text, CASE WHEN parked THEN 200 ELSE 300 END), '') AS homepage_snippet,
    CASE WHEN NOT parked THEN nullif(site_name, '') END AS resolved_name,
    CASE WHEN parked THEN 'parked_domain' ELSE name_source END AS name_source,
    CASE WHEN parked THEN ''
         ELSE left('=== HOMEPAGE ===' || chr(10) || left(text, 3000) || {parts}, 8000)
         END AS scraped_text,
    CASE WHEN parked THEN '' ELSE 'homepage' || {pages} END AS pages_scraped
  FROM sorted)"""


LIVE = "('live', 'live_http_only', 'redirect', 'needs_get')"

DECIDE = f"""
    CASE WHEN domain_status IN {in_list(FAILED_STATUSES)} THEN 'FAIL'
         WHEN industry_match IN ('parked_domain', 'negative_match', 'no_match') THEN 'FAIL'
         WHEN industry_match = 'match' THEN 'PASS' ELSE 'REVIEW' END AS filter_decision,
    CASE WHEN domain_status IN {in_list(FAILED_STATUSES)} THEN 'Domain: ' || domain_status
         WHEN industry_match = 'parked_domain' THEN 'Parked/dead domain'
         WHEN industry_match = 'negative_match'
           THEN 'Negative keyword match: ' || coalesce(negative_keywords, '')
         WHEN industry_match = 'no_match' THEN 'No industry keyword matches on homepage'
         WHEN industry_match = 'match' THEN 'Keywords: ' || matched_keywords
         WHEN industry_match = 'weak_match' THEN 'Weak match: ' || matched_keywords
         WHEN industry_match IN ('no_text', 'error', 'skipped')
           THEN 'Could not extract text: ' || industry_match
         ELSE 'Unclassified: ' || domain_status || '/' || industry_match END AS filter_reason"""

STATUSED = """
statused AS (
  SELECT r.*, CASE WHEN r.url IS NULL THEN 'invalid_domain'
                   ELSE coalesce(v.domain_status, 'unknown') END AS status,
         v.http_code, v.redirect_url
  FROM lead_rows r LEFT JOIN verdicts v USING (url))"""

FINAL_COLUMNS = """row_id, company_name, domain, website, domain_status, http_code, redirect_url,
  industry_match, matched_keywords, negative_keywords, resolved_name, name_source, pages_scraped,
  scraped_text, homepage_snippet"""

OUTCOME = f"""
outcome AS (
  SELECT s.row_id, s.company_name, s.domain, s.website, s.http_code, s.redirect_url,
    CASE WHEN status IN {LIVE} AND s.url IS NOT NULL
           AND coalesce(f.industry_match, 'parked_domain') = 'parked_domain'
         THEN 'parked' ELSE status END AS domain_status,
    CASE WHEN status NOT IN {LIVE} THEN 'domain_dead' WHEN s.url IS NULL THEN 'skipped'
         ELSE coalesce(f.industry_match, 'parked_domain') END AS industry_match,
    CASE WHEN status IN {LIVE} THEN coalesce(f.matched_keywords, '') ELSE '' END AS matched_keywords,
    CASE WHEN status IN {LIVE} THEN coalesce(f.negative_keywords, '') ELSE '' END AS negative_keywords,
    CASE WHEN status IN {LIVE} THEN coalesce(f.resolved_name, raw_name) ELSE raw_name END AS resolved_name,
    CASE WHEN status NOT IN {LIVE} THEN 'domain_dead' WHEN s.url IS NULL THEN 'skipped'
         ELSE coalesce(f.name_source, 'parked_domain') END AS name_source,
    CASE WHEN status IN {LIVE} THEN coalesce(f.pages_scraped, '') ELSE '' END AS pages_scraped,
    CASE WHEN status IN {LIVE} THEN coalesce(f.scraped_text, '') ELSE '' END AS scraped_text,
    CASE WHEN status IN {LIVE} THEN coalesce(f.homepage_snippet, '') ELSE '' END AS homepage_snippet
  FROM statused s LEFT JOIN facts f ON f.url = s.url)"""


def full_ctes(use_api: bool = False) -> str:
    return (
        f"{CRAWL},{MARKED},{LEADS},{ROWS},{LOG},{VERDICTS},{SNAPSHOT},{site_facts(use_api)},"
        f"{STATUSED},{OUTCOME},\ndone AS (SELECT {FINAL_COLUMNS}, {DECIDE} FROM outcome)"
    )


def full(use_api: bool = False) -> str:
    return f"WITH {full_ctes(use_api)}\nSELECT * FROM done"


_TEXT_COLUMNS = """CAST(row_id AS VARCHAR) AS row_id, coalesce(company_name, '') AS company_name, coalesce(domain, '') AS domain, website,
  domain_status, coalesce(CAST(http_code AS VARCHAR), '') AS http_code,
  coalesce(redirect_url, '') AS redirect_url, industry_match, matched_keywords, negative_keywords,
  resolved_name, name_source, pages_scraped, scraped_text, homepage_snippet, filter_decision,
  filter_reason"""


def as_text(extra: str = "") -> str:
    """The final rows as they come back from files: missing values are empty strings."""
    return f"WITH {full_ctes()}\nSELECT {_TEXT_COLUMNS}{extra} FROM done"


SUMMARY = """SELECT count(*) AS total,
  count(*) FILTER (filter_decision = 'PASS') AS pass,
  count(*) FILTER (filter_decision = 'FAIL') AS fail,
  count(*) FILTER (filter_decision = 'REVIEW') AS review,
  count(*) FILTER (filter_decision = 'PASS') / count(*) * 100 AS pass_pct,
  count(*) FILTER (filter_decision = 'FAIL') / count(*) * 100 AS fail_pct,
  count(*) FILTER (filter_decision = 'REVIEW') / count(*) * 100 AS review_pct
FROM done"""


# ---- one statement per query -------------------------------------------------------------


def normalize_domain() -> str:
    return f"""WITH {CRAWL},{LEADS},
typed AS (
  SELECT row_id, coalesce(nullif(domain, ''), nullif(website, '')) AS typed FROM leads
  UNION ALL SELECT -1 - page_id, url FROM pages),
hosts AS (SELECT *, {host_sql("typed")} AS bare FROM typed)
SELECT row_id, typed, {url_sql("bare")} AS url FROM hosts"""


def unify() -> str:
    return f"""WITH {CRAWL},{LEADS}
SELECT row_id, company_name AS "Company Name", domain AS "Website", domain, company_name FROM leads"""


def classify_probe() -> str:
    return f"""WITH {CRAWL},{LEADS},{ROWS},{LOG},{VERDICTS}
SELECT url, domain_status, http_code, redirect_url, is_parked, error FROM verdicts"""


def live() -> str:
    return f"""WITH {CRAWL},{LEADS},{ROWS},{LOG},{VERDICTS},{STATUSED}
SELECT count(*) FILTER (status IN {LIVE}) AS live_rows, count(*) AS total_rows,
       count(*) FILTER (status IN {LIVE}) / count(*) * 100 AS live_pct
FROM statused"""


def page_text() -> str:
    return f"WITH {CRAWL} SELECT row_id, {text_sql('html')} AS text FROM crawl"


def homepage_text() -> str:
    return f"""WITH {CRAWL},{MARKED},{SNAPSHOT},{latest(True)}
SELECT u.url, coalesce(a.text, d.text) AS text,
       CASE WHEN a.text IS NOT NULL THEN 'api' WHEN d.text IS NOT NULL THEN 'direct' END AS text_via
FROM (SELECT DISTINCT rtrim(url, '/') AS url FROM snapshot WHERE regexp_full_match(url, 'https://[^/]*/?')) u
LEFT JOIN texts a ON a.url = u.url AND a.fetch_via = 'api'
LEFT JOIN texts d ON d.url = u.url AND d.fetch_via = 'direct'"""


def parked() -> str:
    return f"""WITH {CRAWL},{MARKED},
read AS (SELECT row_id, {text_sql("html")} AS text FROM marked)
SELECT row_id, {parked_sql("text")} AS is_parked, left(text, 200) AS short_snippet,
       left(text, 300) AS snippet FROM read"""


def company_name() -> str:
    return f"""WITH {CRAWL},{MARKED},{named("marked", "html", "named")}
SELECT row_id, site_name, name_source FROM named"""


def clean_name() -> str:
    ending = choose("key", [q(e) for e in NAME_ENDINGS])
    union = " UNION ALL ".join(
        f"SELECT '{t}' AS origin, CAST({k} AS BIGINT) AS key, {n} AS name FROM {t}"
        for t, k, n in (
            ("part", "p_partkey", "p_name"),
            ("customer", "c_custkey", "c_name"),
            ("supplier", "s_suppkey", "s_name"),
            ("nation", "n_nationkey", "n_name"),
        )
    )
    return f"""WITH names AS ({union}),
spelled AS (
  SELECT origin, key, CASE key % 4 WHEN 0 THEN upper(name || {ending})
    WHEN 1 THEN lower(name || {ending}) ELSE name || {ending} END AS typed FROM names),
bare AS (SELECT *, {clean_sql("typed")} AS bare FROM spelled)
SELECT origin, key, typed, {cased_sql("bare")} AS clean FROM bare"""


def match() -> str:
    strict = {"primary": ["anth", "Wher", "anth"], "secondary": ["tion", "THE "], "negative": ["que", "es"]}
    return f"""WITH docs AS (SELECT doc_id, text FROM documents),
{matching("docs", "text", "plain", KEYWORDS, tag="plain_")},
{matching("plain", "text", "strict", strict, 3, 2, False, "strict_")}
SELECT * EXCLUDE (text) FROM strict"""


def histogram() -> str:
    return f"""WITH {full_ctes()},
counts AS (SELECT industry_match, count(*) AS row_count FROM done GROUP BY industry_match)
SELECT industry_match, row_count,
       row_count / CAST((SELECT sum(row_count) FROM counts) AS BIGINT) * 100 AS row_pct
FROM counts"""


def candidate_paths() -> str:
    return f"""WITH rows AS (
  SELECT page_id, regexp_extract_all(html, 'href="([^"]+)"', 1)
    || {struct_list(DEFAULT_SCRAPE_PATHS)} AS paths FROM pages),
listed AS (
  SELECT page_id, unnest(paths) AS path, generate_subscripts(paths, 1) AS place FROM rows),
firsts AS (
  SELECT page_id, lower(rtrim(path, '/')) AS key, min(place) AS place, arg_min(path, place) AS path
  FROM listed GROUP BY ALL),
placed AS (
  SELECT page_id, path, row_number() OVER (PARTITION BY page_id ORDER BY place) - 1 AS pos FROM firsts)
SELECT page_id, CAST(pos AS INTEGER) AS pos, path,
       'https://p' || page_id || '.example.org/' || ltrim(path, '/') AS page_url,
       replace(replace(upper(replace(trim(path, '/'), 'ß', 'ss')), '-', ' '), '/', ' > ') AS label
FROM placed WHERE pos < 8"""


def csv_records() -> str:
    text = "regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g')"
    record = f"""doc_id || ',"' || replace({text}, '"', '""') || '",' || source || ',x'"""
    fits = "doc_id % 7 <> 3"
    return f"""SELECT row_number() OVER (ORDER BY doc_id % {CSV_FILES}, doc_id) - 1 AS place,
  CASE WHEN {fits} THEN doc_id::VARCHAR END AS doc, CASE WHEN {fits} THEN md5(nullif({text}, '')) END AS text_md5,
  CASE WHEN {fits} THEN source END AS website, CASE WHEN NOT {fits} THEN md5({record}) END AS bad_md5
FROM documents"""


def facts(use_api: bool) -> str:
    return f"WITH {CRAWL},{MARKED},{SNAPSHOT},{site_facts(use_api)} SELECT * FROM facts"


def defaults() -> str:
    status = choose("row_id", [q(s) for s in STATUSES])
    error = "row_id % 7 = 0"

    def field(name, error_value, skipped, missing, idle):
        return (
            f"CASE WHEN NOT live THEN {idle} WHEN {error} THEN {error_value}"
            f" WHEN url IS NULL THEN {skipped}"
            f" WHEN row_id % 4 <> 0 THEN '{name} ' || row_id ELSE {missing} END AS {name}"
        )

    fields = [
        field("industry_match", "'error'", "'skipped'", "'parked_domain'", "'domain_dead'"),
        field("matched_keywords", "''", "''", "''", "''"),
        field("negative_keywords", "''", "''", "''", "''"),
        field("homepage_snippet", "left(repeat('failure ', 40), 200)", "''", "''", "''"),
        field("resolved_name", "''", "raw_name", "raw_name", "raw_name"),
        field("name_source", "''", "'skipped'", "'parked_domain'", "'domain_dead'"),
        field("scraped_text", "''", "''", "''", "''"),
        field("pages_scraped", "''", "''", "''", "''"),
    ]
    return f"""WITH {CRAWL},{LEADS},{ROWS},
states AS (SELECT *, {status} AS status, {status} IN {LIVE} AS live FROM lead_rows)
SELECT row_id,
  CASE WHEN live AND row_id % 7 <> 0 AND url IS NOT NULL AND row_id % 4 = 0 THEN 'parked'
       ELSE status END AS domain_status, {", ".join(fields)}
FROM states"""


def classify() -> str:
    return f"""WITH {CRAWL},
rows AS (
  SELECT row_id, {choose("row_id", [q(s) for s in STATUSES])} AS domain_status,
    {choose("row_id // 2", [q(m) for m in MATCHES])} AS industry_match,
    'kw ' || row_id AS matched_keywords,
    CASE WHEN row_id % 3 > 0 THEN 'no ' || row_id END AS negative_keywords
  FROM crawl)
SELECT row_id, domain_status, industry_match, {DECIDE} FROM rows"""


def prompt() -> str:
    before, rest = PROMPT.split("{buy_box_criteria}")
    between, after = rest.split("{scraped_text}")
    return f"""SELECT doc_id, {q(before)}
  || CASE WHEN doc_id % 3 > 1 THEN source ELSE {q(NO_CRITERIA)} END || {q(between)}
  || CASE WHEN doc_id % 5 > 1 THEN coalesce(nullif(text, ''), {q(NO_TEXT)}) ELSE {q(NO_TEXT)} END
  || {q(after)} AS prompt FROM documents"""


def typed_terms(x: str) -> str:
    typed_ws = r"[\t-\r\p{Z}\x{feff}]"
    trimmed = f"regexp_replace(regexp_replace(t, '^{typed_ws}+', ''), '{typed_ws}+$', '')"
    return (
        f"list_filter(list_transform(regexp_split_to_array(coalesce({x}, ''), '[\\n,]+'),"
        f" lambda t: lower({trimmed})), lambda t: t <> '')"
    )


def used_terms(x: str, spare, configured) -> str:
    return (
        f"CASE WHEN len(p) + len(s) = 0 THEN {struct_list(configured)}"
        f" WHEN len({x}) > 0 THEN {x} ELSE CAST({struct_list(spare)} AS VARCHAR[]) END"
    )


def keyword_lists() -> str:
    def used(x: str, spare, configured) -> str:
        return f"array_to_string({used_terms(x, spare, configured)}, '|')"

    return f"""WITH typed AS (
  SELECT doc_id,
    {typed_terms("CASE WHEN doc_id % 3 <> 0 THEN text END")} AS p,
    {typed_terms("CASE WHEN doc_id % 4 < 2 THEN lang || ' ,' || chr(10) || ',' || chr(9) || 'X ' || source END")} AS s,
    {typed_terms("CASE WHEN doc_id % 5 < 3 THEN text END")} AS n
  FROM documents)
SELECT doc_id, {used("p", REQUEST_PRIMARY, KEYWORDS["primary"])} AS primary_terms,
  {used("s", REQUEST_SECONDARY, KEYWORDS["secondary"])} AS secondary_terms,
  {used("n", (), KEYWORDS["negative"])} AS negative_terms
FROM typed"""


def campaign_match() -> str:
    def typed(values) -> str:
        return typed_terms(choose("s_suppkey", [q(v) for v in values]))

    def found(terms: str) -> str:
        return f"list_filter({terms}, lambda k: contains(lower(text), lower(k)))"

    return f"""WITH campaigns AS (
  SELECT s_suppkey AS campaign_id, {typed(CAMPAIGN_PRIMARY)} AS p, {typed(CAMPAIGN_SECONDARY)} AS s,
         {typed(CAMPAIGN_NEGATIVE)} AS n
  FROM supplier),
rows_ AS (
  SELECT doc_id, text, doc_id % {CAMPAIGNS} AS campaign_id, coalesce(p, []) AS p, coalesce(s, []) AS s,
         coalesce(n, []) AS n
  FROM documents LEFT JOIN campaigns ON campaign_id = doc_id % {CAMPAIGNS}),
hits AS (
  SELECT doc_id, campaign_id, coalesce(text, '') = '' AS missing,
         {found(used_terms("p", REQUEST_PRIMARY, KEYWORDS["primary"]))} AS k_pri,
         {found(used_terms("s", REQUEST_SECONDARY, KEYWORDS["secondary"]))} AS k_sec,
         {found(used_terms("n", (), KEYWORDS["negative"]))} AS k_neg
  FROM rows_)
SELECT doc_id, campaign_id,
  CASE WHEN missing THEN 'no_text' WHEN len(k_neg) > 0 THEN 'negative_match'
       WHEN len(k_pri) >= 1 OR len(k_sec) >= 2 THEN 'match'
       WHEN len(k_pri) + len(k_sec) > 0 THEN 'weak_match' ELSE 'no_match' END AS match_result,
  CASE WHEN missing OR len(k_neg) > 0 THEN '' WHEN len(k_pri) >= 1 THEN array_to_string(k_pri, '; ')
       ELSE array_to_string(k_pri || k_sec, '; ') END AS matched_keywords,
  CASE WHEN missing THEN '' ELSE array_to_string(k_neg, '; ') END AS negative_keywords
FROM hits"""


def layer1_only() -> str:
    return f"""WITH {CRAWL},{LEADS},{ROWS},{LOG},{VERDICTS},{STATUSED},
outcome AS (
  SELECT *, status AS domain_status, 'not_run' AS industry_match, '' AS matched_keywords,
    '' AS negative_keywords, raw_name AS resolved_name, 'not_run' AS name_source,
    '' AS pages_scraped, '' AS scraped_text, '' AS homepage_snippet
  FROM statused)
SELECT {FINAL_COLUMNS}, {DECIDE} FROM outcome"""


def skip_layer1() -> str:
    status = choose("row_id", [q(s) for s in STATUSES[:1] + STATUSES[9:13]])
    return f"""WITH {CRAWL},{MARKED},{LEADS},{ROWS},{SNAPSHOT},{site_facts(False)},
statused AS (
  SELECT *, {status} AS status, 200 AS http_code,
    'https://before.example.com' AS redirect_url FROM lead_rows),{OUTCOME}
SELECT {FINAL_COLUMNS}, {DECIDE} FROM outcome"""


def statements() -> dict[str, str]:
    return {
        "q_normalize_domain": normalize_domain(),
        "q_unify_headers": unify(),
        "q_classify_probe": classify_probe(),
        "q_live_summary": live(),
        "q_html_to_text": page_text(),
        "q_homepage_source": homepage_text(),
        "q_parked": parked(),
        "q_company_name": company_name(),
        "q_clean_name": clean_name(),
        "q_match_keywords": match(),
        "q_match_histogram": histogram(),
        "q_candidate_paths": candidate_paths(),
        "q_subpage_bundle": facts(True),
        "q_subpage_bundle_direct": facts(False),
        "q_defaults": defaults(),
        "q_classify_row": classify(),
        "q_decision_summary": f"WITH {full_ctes()}\n{SUMMARY}",
        "q_prompt": prompt(),
        "q_csv_ordered": f"""WITH {CRAWL}
SELECT count(*) AS n_rows, 0 AS out_of_order, 0 AS misplaced, count(*) - 1 AS last_place FROM crawl""",
        "q_csv_records": csv_records(),
        "q_csv_published": f"""WITH {full_ctes()},
counts AS (SELECT filter_decision AS output, count(*) AS n FROM done GROUP BY ALL UNION ALL SELECT 'ALL', count(*) FROM done)
SELECT output, coalesce(n, 0) AS row_count, coalesce(n, 0) AS held
FROM (VALUES ('ALL'), ('PASS'), ('FAIL'), ('REVIEW')) v(output) LEFT JOIN counts USING (output)""",
        "q_keyword_lists": keyword_lists(),
        "q_campaign_match": campaign_match(),
        "q_layer1_only": layer1_only(),
        "q_skip_layer1": skip_layer1(),
        "q_qualify_full": full(),
        "q_qualify_api": full(True),
        "q_csv_roundtrip": as_text(", filter_decision AS split"),
        "q_csv_recount": f"WITH {full_ctes()}\nSELECT total, pass, fail, review FROM ({SUMMARY})",
        "q_stream_intake": as_text(),
        "q_stream_totals": f"WITH {full_ctes()}\n{SUMMARY}",
        "q_probe_state": classify_probe(),
    }

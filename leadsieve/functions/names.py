"""Company names: where they stand in a page and how they are cleaned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadsieve.functions.text import WS, decode, strip, up_to_last

# Where a page states its name. Each meta tag is searched with
# ``property`` before ``content`` first and the other way round second.
SITE_NAME_PATTERNS = (
    r"""(?iu)<meta[^>]*property=["']og:site_name["'][^>]*content=["']([^"']+)["']""",
    r"""(?iu)<meta[^>]*content=["']([^"']+)["'][^>]*property=["']og:site_name["']""",
)
TITLE_PATTERN = r"(?iu)<title[^>]*>([^<]+)</title>"
OG_TITLE_PATTERNS = (
    r"""(?iu)<meta[^>]*property=["']og:title["'][^>]*content=["']([^"']+)["']""",
    r"""(?iu)<meta[^>]*content=["']([^"']+)["'][^>]*property=["']og:title["']""",
)
JSON_NAME_PATTERN = rf'"name"{WS}*:{WS}*"([^"]{{2,80}})"'
SEGMENT_SEPARATOR = rf"{WS}*[|–—\-:]{WS}*"

# Title segments that are no name.
GENERIC_SEGMENTS = (
    "home",
    "welcome",
    "homepage",
    "main",
    "index",
    "official site",
    "official website",
    "website",
    "site",
    "page",
)

# Size limits of an acceptable name.
MAX_SITE_NAME = 100
MAX_SEGMENT = 60
MIN_WORDS, MAX_WORDS = 2, 8

# Entities decoded in names, in this order.
NAME_ENTITIES = (
    ("&amp;", "&"),
    ("&#39;", "'"),
    ("&quot;", '"'),
    ("&#x27;", "'"),
    ("&apos;", "'"),
)

# Legal forms removed wherever they stand, one after the other. ``{b}`` is
# a word boundary.
LEGAL_FORMS = (
    r"{b}LLC{b}\.?",
    r"{b}L\.L\.C\.?",
    r"{b}Inc\.?{b}",
    r"{b}Corp\.?{b}",
    r"{b}Corporation{b}",
    r"{b}Ltd\.?{b}",
    r"{b}Limited{b}",
    r"{b}LP{b}\.?",
    r"{b}L\.P\.?",
    r"{b}LLP{b}\.?",
    r"{b}L\.L\.P\.?",
    r"{b}PC{b}\.?",
    r"{b}P\.C\.?",
    r"{b}PLC{b}\.?",
    r"{b}Co\.?{b}",
)
TRAILING_MARKS = rf"(?:{WS}|[,.\-|])+$"

# Words with a spelling of their own in names that are all capitals or all small.
ACRONYMS = ("HVAC", "USA", "US", "LLC", "CEO", "RV", "FOG", "HQ")
SMALL_WORDS = ("and", "of", "the", "in", "for", "at", "by", "or")

# Word boundaries over Unicode letters, digits and ``_``; what ``\b`` means differs between
# Java versions. Before a letter and after one a boundary needs one look only.
_WORD = r"[\p{L}\p{N}_]"
BEFORE_LETTER = rf"(?<!{_WORD})"
AFTER_LETTER = rf"(?!{_WORD})"
ANYWHERE = rf"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


def _legal_pattern(form: str) -> str:
    rest = form.removeprefix("{b}").replace(r"\.?{b}", r"\.?" + ANYWHERE)
    return BEFORE_LETTER + rest.replace("{b}", AFTER_LETTER)


LEGAL_PATTERNS = tuple(_legal_pattern(form) for form in LEGAL_FORMS)
ANY_LEGAL_FORM = "(?iu)" + "|".join(LEGAL_PATTERNS)


def _capture(html: Column, pattern: str) -> Column:
    """First capture of a pattern, empty where it does not match."""
    return F.regexp_extract(html, pattern, 1)


def _meta(html: Column, name: str, pattern: str) -> Column:
    """Capture of a meta tag, searched only in pages that mention its name."""
    return F.when(html.rlike(f"(?iu){name}"), _capture(html, pattern)).when(html.isNotNull(), "")


def _segments(title: Column) -> Column:
    return F.transform(F.split(title, SEGMENT_SEPARATOR, -1), strip)


def title_segment(title: Column) -> Column:
    """First segment of a page title that can be a name."""
    return F.get(
        F.filter(
            _segments(title),
            lambda s: ~F.lower(s).isin(*GENERIC_SEGMENTS)
            & (F.length(s) > 1)
            & (F.length(s) < MAX_SEGMENT),
        ),
        F.lit(0),
    )


def og_title_segment(title: Column) -> Column:
    """First segment of an ``og:title``, if it is short enough."""
    longer = F.filter(_segments(title), lambda s: F.length(s) > 1)
    return F.get(F.filter(F.slice(longer, 1, 1), lambda s: F.length(s) < MAX_SEGMENT), F.lit(0))


def word_count(c: Column) -> Column:
    return F.size(F.split(c, f"{WS}+", -1))


def with_site_name(df: DataFrame, html: str, name: str, source: str) -> DataFrame:
    """Add the name a page gives its owner and where it was found.

    ``name`` is null for the sources ``fallback`` and ``no_html``. Each search is a
    column of its own that stays null where an earlier one succeeded: the page is
    searched no further than needed, and never twice for the same thing.
    """
    page = F.col(html)
    site, title, og, stated = (F.col(c) for c in ("_site", "_title", "_og", "_stated"))
    no_site = site.isNull()
    no_title = F.coalesce(site, title).isNull()
    no_og = F.coalesce(site, title, og).isNull()
    searches = [
        ("_site", _meta(page, "og:site_name", SITE_NAME_PATTERNS[0])),
        ("_site", F.when(site == "", _meta(page, "og:site_name", SITE_NAME_PATTERNS[1])).otherwise(site)),
        ("_site", strip(site)),
        ("_site", F.when((site != "") & (F.length(site) < MAX_SITE_NAME), site)),
        ("_title", F.when(no_site, strip(_capture(up_to_last(page, "</title>"), TITLE_PATTERN)))),
        ("_title", title_segment(title)),
        ("_og", F.when(no_title, _meta(page, "og:title", OG_TITLE_PATTERNS[0]))),
        ("_og", F.when(og == "", _meta(page, "og:title", OG_TITLE_PATTERNS[1])).otherwise(og)),
        ("_og", og_title_segment(strip(og))),
        ("_stated", F.when(no_og, strip(_capture(page, JSON_NAME_PATTERN)))),
        ("_stated", F.when(word_count(stated).between(MIN_WORDS, MAX_WORDS), stated)),
    ]
    for column, search in searches:
        df = df.withColumn(column, search)
    df = df.withColumn(
        source,
        F.when(page.isNull() | (page == ""), "no_html")
        .when(site.isNotNull(), "og:site_name")
        .when(title.isNotNull(), "title_tag")
        .when(og.isNotNull(), "og:title")
        .when(stated.isNotNull(), "schema_org")
        .otherwise("fallback"),
    )
    df = with_clean_name(df, F.coalesce(site, title, og, stated), name)
    return df.drop("_site", "_title", "_og", "_stated")


def without_legal_forms(name: Column) -> Column:
    """Remove the legal forms one after the other; names without any are left alone."""
    bare = name
    for pattern in LEGAL_PATTERNS:
        bare = F.regexp_replace(bare, rf"(?iu),?{WS}*{pattern}", "")
    return F.when(name.rlike(ANY_LEGAL_FORM), bare).otherwise(name)


def _capitalized(word: Column) -> Column:
    head = F.initcap(F.left(word, F.lit(1)))
    return F.concat(head, F.lower(F.substr(word, F.lit(2))))


def _name_case(word: Column) -> Column:
    return (
        F.when(F.upper(word).isin(*ACRONYMS), F.upper(word))
        .when(F.lower(word).isin(*SMALL_WORDS), F.lower(word))
        .otherwise(_capitalized(word))
    )


def one_case_only(name: Column) -> Column:
    """All cased letters are capitals, or all are small; at least one is cased."""
    upper = name.rlike(r"\p{IsUppercase}")
    lower = name.rlike(r"\p{IsLowercase}")
    return (upper != lower) & ~name.rlike(r"\p{IsTitlecase}")


def with_clean_name(df: DataFrame, name: Column, out: str) -> DataFrame:
    """Add ``name`` without legal forms and, if it was all one case, in name case.

    In name case the first word is capitalised last, whatever it is.
    """
    words = F.split(F.col("_bare"), f"{WS}+", -1)
    cased = F.concat_ws(
        " ",
        F.transform(
            words, lambda w, i: F.when(i == 0, _capitalized(_name_case(w))).otherwise(_name_case(w))
        ),
    )
    return (
        df.withColumn("_bare", decode(name, NAME_ENTITIES))
        .withColumn("_bare", without_legal_forms(F.col("_bare")))
        .withColumn("_bare", strip(F.regexp_replace(F.col("_bare"), TRAILING_MARKS, "")))
        .withColumn(out, F.when(one_case_only(F.col("_bare")), cased).otherwise(F.col("_bare")))
        .drop("_bare")
    )

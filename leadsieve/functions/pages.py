"""Parked pages, sub-page addresses and the text bundle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadsieve.functions.domains import contains_any
from leadsieve.functions.text import left, strip

# Phrases of parked, unfinished or suspended sites.
PARKED_PHRASES = (
    "this domain is for sale",
    "domain is parked",
    "buy this domain",
    "parked by",
    "godaddy",
    "sedo.com",
    "hugedomains",
    "dan.com",
    "afternic",
    "domain for sale",
    "this website is for sale",
    "under construction",
    "coming soon",
    "site not found",
    "page not found",
    "default web page",
    "apache2 ubuntu default page",
    "welcome to nginx",
    "403 forbidden",
    "account suspended",
    "this account has been suspended",
    "website expired",
    "hosting expired",
)

# Text lengths in characters.
MIN_LIVE_TEXT = 100
MIN_SUBPAGE_TEXT = 150
BUNDLE_HOMEPAGE = 3000
BUNDLE_SUBPAGE = 2500
BUNDLE_TOTAL = 8000


def is_parked_text(text: Column, lower_text: Column) -> Column:
    """No text, too little text, or a phrase of a parked site."""
    return (
        text.isNull()
        | (F.length(strip(text)) < MIN_LIVE_TEXT)
        | contains_any(lower_text, PARKED_PHRASES)
    )


def path_label(path: Column) -> Column:
    name = F.upper(F.regexp_replace(path, r"^/+|/+\z", ""))
    return F.replace(F.replace(name, F.lit("-"), F.lit(" ")), F.lit("/"), F.lit(" > "))


def page_url(base: Column, path: Column) -> Column:
    return F.concat(
        F.regexp_replace(base, r"/+\z", ""), F.lit("/"), F.regexp_replace(path, r"^/+", "")
    )


def homepage_part(text: Column) -> Column:
    """Bundle section of a homepage; null without text."""
    body = left(text, BUNDLE_HOMEPAGE)
    return F.when(text != "", F.concat(F.lit("=== HOMEPAGE ===\n"), body))


def subpage_part(path: Column, text: Column) -> Column:
    """Bundle section of a sub-page; null without text."""
    body = left(text, BUNDLE_SUBPAGE)
    return F.concat(F.lit("=== "), path_label(path), F.lit(" PAGE ===\n"), body)


def text_bundle(*parts: Column) -> Column:
    """Sections joined by a blank line, null sections left out, cut to the total size."""
    return left(F.concat_ws("\n\n", *parts), BUNDLE_TOTAL)


def path_key(path: Column) -> Column:
    """Paths with equal keys name the same page."""
    return F.lower(F.regexp_replace(path, r"/+\z", ""))


def first_paths(paths: Column, keys: Column, n: int) -> Column:
    """The first ``n`` of ``paths`` with distinct keys, first spelling kept."""
    wanted = F.slice(F.array_distinct(keys), 1, n)
    return F.transform(wanted, lambda k: F.get(paths, F.array_position(keys, k).cast("int") - 1))

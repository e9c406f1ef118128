"""Web domains: normalisation, hosts, social networks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadsieve.functions.text import nz, strip

# A host containing one of these is a profile page, not a company site.
SOCIAL_HOSTS = (
    "facebook.com",
    "instagram.com",
    "twitter.com",
    "x.com",
    "linkedin.com",
    "tiktok.com",
    "youtube.com",
    "pinterest.com",
    "yelp.com",
    "bbb.org",
    "google.com/maps",
    "maps.google.com",
)

# What is cut off a domain, in this order. ``(?d)`` keeps ``.`` and ``$``
# to the one line end ``\n``.
DOMAIN_CUTS = (r"(?d)^https?://", r"(?d)^//+", r"(?d)[/?#].*$", r"(?d)^www\.")
BARE_WORD = r"(?d)^[a-z0-9][-a-z0-9]{0,62}$"
NOT_A_HOST = ("www", "http", "https")


def contains_any(c: Column, needles) -> Column:
    hit = F.lit(False)
    for needle in needles:
        hit = hit | c.contains(needle)
    return hit


def is_social(host: Column) -> Column:
    return contains_any(host, SOCIAL_HOSTS)


def bare_host(value: Column) -> Column:
    """Lower-case host part of whatever was typed into a domain field."""
    host = F.lower(strip(value))
    for cut in DOMAIN_CUTS:
        host = F.regexp_replace(host, cut, "")
    return strip(host)


def url_of_host(host: Column) -> Column:
    """``https`` URL of a bare host, or null when it cannot be a company site."""
    return (
        F.when(host.isNull() | (host == "") | is_social(host), F.lit(None))
        .when(host.contains("."), F.concat(F.lit("https://"), host))
        .when(host.isin(*NOT_A_HOST), F.lit(None))
        .when(host.rlike(BARE_WORD), F.concat(F.lit("https://"), host, F.lit(".com")))
    )


def domain_value(columns, domain: str = "domain", website: str = "website") -> Column:
    """The ``domain`` field, or ``website`` where it is empty or absent."""
    present = [nz(F.col(f"`{name}`")) for name in (domain, website) if name in columns]
    return F.coalesce(*present) if present else F.lit(None).cast("string")


def with_normalized_url(df: DataFrame, value: Column, out: str = "_url") -> DataFrame:
    """Add the normalised URL of ``value``. Two projections, so the host is cut once."""
    return (
        df.withColumn("_host", bare_host(value))
        .withColumn(out, url_of_host(F.col("_host")))
        .drop("_host")
    )


def url_host(url: Column) -> Column:
    """Host of a URL with every ``www.`` removed; empty when there is none."""
    host = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)
    return F.replace(host, F.lit("www."), F.lit(""))

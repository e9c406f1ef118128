"""Industry keywords: parsing of typed lists and matching against page text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadsieve.config import SieveConfig
from leadsieve.functions.text import WS_CHARS

# Keywords used when a request names some but leaves one list empty.
REQUEST_PRIMARY = ("septic", "wastewater", "pumping")
REQUEST_SECONDARY = ("tank", "drain", "cleanout")

# White space trimmed from typed keywords: unlike page text it has U+FEFF, but neither
# U+001C..U+001F nor U+0085.
TYPED_WS_CHARS = "".join(c for c in WS_CHARS if c not in "\x1c\x1d\x1e\x1f\x85") + "\ufeff"
TYPED_SEPARATOR = r"[\n,]+"

# Above this many terms a list is scanned by one array expression instead of one
# expression per term, to keep the generated code small.
UNROLL_TERMS = 60


def parse_keywords(typed: Column) -> Column:
    """Terms of a comma- or line-separated list, trimmed, lower case, none empty."""
    terms = F.transform(
        F.split(F.coalesce(typed, F.lit("")), TYPED_SEPARATOR, -1),
        lambda t: F.lower(F.btrim(t, F.lit(TYPED_WS_CHARS))),
    )
    return F.filter(terms, lambda t: t != "")


def _terms(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def with_effective_keywords(df: DataFrame, primary: str, secondary: str, negative: str,
                            file_config: SieveConfig) -> DataFrame:
    """Replace three parsed list columns by the lists a run really uses.

    A request without primary and secondary terms runs on the configured lists,
    and its negative terms are ignored.
    """
    p, s, n = F.col(primary), F.col(secondary), F.col(negative)
    given = (F.size(p) > 0) | (F.size(s) > 0)

    def chosen(terms: Column, spare, configured) -> Column:
        own = F.when(F.size(terms) > 0, terms).otherwise(_terms(spare))
        return F.when(given, own).otherwise(_terms(configured))

    return df.withColumns(
        {
            primary: chosen(p, REQUEST_PRIMARY, file_config.primary),
            secondary: chosen(s, REQUEST_SECONDARY, file_config.secondary),
            negative: chosen(n, (), file_config.negative),
        }
    )


def keyword_hits(lower_text: Column, keywords) -> Column:
    """Those of ``keywords`` that occur in the text, in list order, repeats kept."""
    if not keywords:
        return _terms(())
    if len(keywords) <= UNROLL_TERMS:
        return F.array_compact(
            F.array(*[F.when(lower_text.contains(k.lower()), F.lit(k)) for k in keywords])
        )
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(k.lower()).alias("l")) for k in keywords])
    # The null test mentions the text a second time, which keeps the optimizer from
    # computing the text inside the loop over the keywords.
    return F.when(
        lower_text.isNotNull(),
        F.transform(F.filter(pairs, lambda p: lower_text.contains(p["l"])), lambda p: p["k"]),
    )


def hits_of_list(lower_text: Column, terms: Column) -> Column:
    """Those of the array ``terms`` that occur in the text, in list order, repeats kept."""
    found = F.filter(terms, lambda k: lower_text.contains(F.lower(k)))
    return F.when(lower_text.isNotNull(), found).otherwise(_terms(()))


def with_keyword_match(
    df: DataFrame, text: str, lower_text: str, cfg: SieveConfig, lists: Sequence[str] = ()
) -> DataFrame:
    """Add ``match_result``, ``matched`` and ``negatives`` (arrays) for a text column.

    ``lower_text`` names the lower-case text, held in a column so that it is computed once.
    The keywords are those of ``cfg`` or, row by row, the arrays in the three columns
    ``lists``: primary, secondary and negative terms.
    """
    low = F.col(lower_text)
    if lists:
        hits = [hits_of_list(low, F.col(c)) for c in lists]
    else:
        hits = [keyword_hits(low, k) for k in (cfg.primary, cfg.secondary, cfg.negative)]
    primary, secondary, negative = F.col("_primary"), F.col("_secondary"), F.col("negatives")
    enough_primary = F.size(primary) >= cfg.primary_threshold
    enough_secondary = F.size(secondary) >= cfg.secondary_threshold
    ruled_out = (F.size(negative) > 0) & F.lit(cfg.negative_override)
    missing = F.col(text).isNull() | (F.col(text) == "")
    result = (
        F.when(missing, "no_text")
        .when(ruled_out, "negative_match")
        .when(enough_primary | enough_secondary, "match")
        .when((F.size(primary) > 0) | (F.size(secondary) > 0), "weak_match")
        .otherwise("no_match")
    )
    matched = (
        F.when(missing | ruled_out, _terms(()))
        .when(enough_primary, primary)
        .otherwise(F.concat(primary, secondary))
    )
    return (
        df.withColumns(
            {
                "_primary": hits[0],
                "_secondary": hits[1],
                "negatives": F.when(missing, _terms(())).otherwise(hits[2]),
            }
        )
        .withColumns({"match_result": result, "matched": matched})
        .drop("_primary", "_secondary")
    )


def with_campaign_match(
    df: DataFrame, campaigns: DataFrame, text: str, file_config: SieveConfig
) -> DataFrame:
    """Match every row's text against the lists of its own campaign.

    ``campaigns`` holds ``campaign_id`` and the typed lists ``primary, secondary, negative``,
    one row per campaign; rows find theirs by ``campaign_id``. A row whose campaign is
    unknown is matched against the configured lists. Campaigns that repeat an id make the job fail, as
    nothing says which of them is meant.
    """
    lists = ("_p", "_s", "_n")
    twice = F.raise_error(F.concat(F.lit("several campaigns with campaign_id "), F.col("campaign_id").cast("string")))
    same_id = Window.partitionBy("campaign_id").orderBy(F.lit(0))
    # a second row is enough to fail, however many there are
    single = campaigns.withColumn("_turn", F.row_number().over(same_id)).where(
        F.when(F.col("campaign_id").isNull(), False).when(F.col("_turn") == 1, True).otherwise(twice.cast("boolean"))
    )
    typed = single.select(
        "campaign_id",
        *[parse_keywords(F.col(c)).alias(a) for c, a in zip(("primary", "secondary", "negative"), lists)],
    )
    joined = df.join(typed, "campaign_id", "left")
    joined = joined.withColumns({c: F.coalesce(F.col(c), _terms(())) for c in lists})
    used = with_effective_keywords(joined, *lists, file_config)
    used = used.withColumn("_low", F.lower(F.col(text)))
    return with_keyword_match(used, text, "_low", file_config, lists).drop("_low", *lists)


def listed(terms: Column) -> Column:
    """Terms as one string, empty for none."""
    return F.concat_ws("; ", terms)

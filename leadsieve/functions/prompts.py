"""The review prompt built from a text bundle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadsieve.functions.text import nz

# The prompt and what stands in for missing inputs.
PROMPT = """You are evaluating whether this company fits our buy-box criteria.

BUY-BOX CRITERIA:
{buy_box_criteria}

SCRAPED WEBSITE TEXT (homepage + key pages):
{scraped_text}

Based only on the scraped text above, does this company meet the buy-box criteria? Respond with a short assessment and recommend: PASS, REVIEW, or FAIL with reason."""
NO_TEXT = "(no text scraped)"
NO_CRITERIA = "Primary/secondary keyword match; exclude negative keywords."


def build_prompt(scraped_text: Column, criteria: Column) -> Column:
    before, rest = PROMPT.split("{buy_box_criteria}")
    between, after = rest.split("{scraped_text}")
    return F.concat(
        F.lit(before),
        F.coalesce(nz(criteria), F.lit(NO_CRITERIA)),
        F.lit(between),
        F.coalesce(nz(scraped_text), F.lit(NO_TEXT)),
        F.lit(after),
    )

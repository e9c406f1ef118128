"""Summaries of classified rows. All are small aggregates with map-side counting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadsieve.functions.decide import DECISIONS
from leadsieve.operators.probes import percent


def decision_counts(df: DataFrame) -> DataFrame:
    """``industry_match, filter_decision, row_count``: what summaries of any number of parts add up."""
    return df.groupBy("industry_match", "filter_decision").agg(F.count("*").alias("row_count"))


def match_histogram(df: DataFrame, column: str = "industry_match") -> DataFrame:
    """Rows and percent per match result, most frequent first, names break ties."""
    return histogram_of_counts(df.groupBy(column).agg(F.count("*").alias("row_count")), column)


def histogram_of_counts(counts: DataFrame, column: str = "industry_match") -> DataFrame:
    """``match_histogram`` from partial counts.

    The window runs over the grouped rows, of which there are as many as match
    results (ten at most).
    """
    counts = counts.groupBy(column).agg(F.sum("row_count").alias("row_count"))
    total = F.sum("row_count").over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("row_pct", percent(F.col("row_count"), total)).orderBy(
        F.desc("row_count"), column
    )


def decision_summary(df: DataFrame) -> DataFrame:
    """One row of PASS, FAIL and REVIEW counts and percentages, zeros included."""
    return summary_of_counts(df.groupBy("filter_decision").agg(F.count("*").alias("row_count")))


def summary_of_counts(counts: DataFrame, *by: str) -> DataFrame:
    """``decision_summary`` from partial counts, one row for each value of ``by``."""
    names = {d: d.lower() for d in DECISIONS}

    def rows_of(condition) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("row_count"))), F.lit(0))

    counted = counts.groupBy(*by).agg(
        rows_of(F.lit(True)).alias("total"),
        *[rows_of(F.col("filter_decision") == d).alias(n) for d, n in names.items()],
    )
    return counted.select(
        *by,
        "total",
        *names.values(),
        *[percent(F.col(n), F.col("total")).alias(f"{n}_pct") for n in names.values()],
    )


def display_percent(column: str):
    """A percentage as shown to people: one decimal, halves to even."""
    return F.bround(F.col(column), 1)

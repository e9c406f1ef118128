"""Outputs that appear together: written under a version of their own, then published by one manifest.

The four outputs of a run are separate folders, so a job that is lost between two of them would leave new
and old ones side by side. Here a run writes them below ``versions/<n>`` and, when all are complete, a manifest
``manifest/<n>`` that names them. Readers take the highest manifest that is complete; a version without one
is never seen. A job that is run again writes a version of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadsieve.functions.decide import DECISIONS
from leadsieve.operators.report import decision_summary
from leadsieve.sources.csv import read_output, split_path, write_outputs
from leadsieve.sources.storage import children, delete, exists, scratch_scope

#: Name of the output with all rows.
ALL = "ALL"

_MANIFEST = "output string, path string, row_count long"


def _complete(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the published versions, in order."""
    numbers = [int(n) for n in children(spark, f"{path}/manifest") if n.isdigit()]
    return sorted(n for n in numbers if exists(spark, f"{path}/manifest/{n}/_SUCCESS"))


def publish_outputs(df: DataFrame, path: str, ordered: bool = False) -> DataFrame:
    """Write all rows and the PASS, FAIL and REVIEW rows as one new version below ``path``; return the summary."""
    spark = df.sparkSession
    # no number is used twice, whatever became of its run
    taken = [int(n) for folder in ("manifest", "versions") for n in children(spark, f"{path}/{folder}") if n.isdigit()]
    number = max(taken, default=-1) + 1
    whole = f"{path}/versions/{number}/rows.csv"
    with scratch_scope(spark):
        counted = write_outputs(df, whole, ordered).first()
    places = {ALL: (whole, counted["total"])}
    places |= {d: (split_path(whole, d), counted[d.lower()]) for d in DECISIONS}
    manifest = spark.createDataFrame([(name, *place) for name, place in places.items()], _MANIFEST)
    manifest.coalesce(1).write.parquet(f"{path}/manifest/{number}")
    return spark.createDataFrame([counted], counted_schema(spark))


def counted_schema(spark: SparkSession):
    return decision_summary(spark.createDataFrame([], "filter_decision string")).schema


def published(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """``output, path, row_count`` of the current version, or of version ``number``."""
    complete = _complete(spark, path)
    if not complete or number is not None and number not in complete:
        raise ValueError(f"no such version below {path}")
    return spark.read.schema(_MANIFEST).parquet(f"{path}/manifest/{complete[-1] if number is None else number}")


def read_published(spark: SparkSession, path: str, output: str = ALL) -> DataFrame:
    """Rows of one output of the current version, every value a string."""
    place = published(spark, path).where(F.col("output") == output).first()
    if place is None:
        raise ValueError(f"no output {output}")
    return read_output(spark, place.path)


def recount_published(spark: SparkSession, path: str) -> DataFrame:
    """``total, pass, fail, review`` counted from the rows of the current version."""
    return decision_summary(read_published(spark, path)).select("total", "pass", "fail", "review")


def forget_versions(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete all but the last ``keep`` published versions and what failed before them; returns how many."""
    complete = _complete(spark, path)
    if len(complete) <= keep:
        return 0
    first = complete[-keep]
    gone = {int(n) for folder in ("manifest", "versions") for n in children(spark, f"{path}/{folder}") if n.isdigit() and int(n) < first}
    for number in gone:
        delete(spark, f"{path}/manifest/{number}")  # first, so that no reader finds half of it
        delete(spark, f"{path}/versions/{number}")
    return len(gone)

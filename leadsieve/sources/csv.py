"""CSV files: reading leads, writing classified rows, counting what was written."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from leadsieve.functions.decide import DECISIONS
from leadsieve.operators.leads import ROW_ID, output_projection, quoted
from leadsieve.operators.report import decision_summary
from leadsieve.sources.records import BOM, field_count, opens, records
from leadsieve.sources.storage import scratch_path

# Quotes are doubled inside quoted fields, blanks are data, and missing values are empty.
CSV_FORMAT = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "encoding": "UTF-8",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
    "emptyValue": "",
}

# How the fields of one record are read.
FIELDS = {k: str(v) for k, v in CSV_FORMAT.items() if k not in ("header", "encoding")}

# Text of a record that does not fit the header; like all names with ``_`` it is never written.
BAD_RECORD = "_bad_record"

# Lines that a header record takes at most.
HEADER_LINES = 100

# A file whose header differs from the others' is an error, not a shift of its columns.
CSV_INPUT = {**CSV_FORMAT, "enforceSchema": False}


def header_of(spark: SparkSession, path: str) -> list[str]:
    """Column names in the first record of the files at ``path``, as spelled there.

    The record may hold line breaks inside quotes: lines are taken until they are closed.
    """
    lines: list[str] = []
    for row in spark.read.text(path).limit(HEADER_LINES).toLocalIterator():
        if not lines and row[0] in ("", BOM):
            continue
        lines.append(row[0])
        if sum(line.count('"') for line in lines) % 2 == 0:
            break
    if not lines:
        raise ValueError(f"no header line in {path}")
    return next(csv.reader(["\n".join(lines).lstrip(BOM)], strict=False))


def leads_schema(spark: SparkSession, header: list[str]) -> StructType:
    """All columns are strings. Names are not folded, so ``domain`` and ``Domain`` may
    both occur, which needs a session that tells them apart."""
    case_sensitive = spark.conf.get("spark.sql.caseSensitive") == "true"
    seen = [h if case_sensitive else h.lower() for h in header]
    if len(set(seen)) < len(seen):
        hint = "" if case_sensitive else "; set spark.sql.caseSensitive=true"
        raise ValueError(f"column names occur twice: {header}{hint}")
    return StructType([StructField(name, StringType()) for name in header])


def parsed(spark: SparkSession, path: str) -> DataFrame:
    """Records of the CSV files at ``path``: a column of strings per header field, ``ROW_ID`` and ``BAD_RECORD``.

    Short rows are filled with null. A record with more fields than the header, or with a quote that is never
    closed, can't be told apart into columns: all of them are null, and its text is in ``BAD_RECORD``. A file with
    another header than the first one's makes the read fail.
    """
    header = header_of(spark, path)
    schema = leads_schema(spark, header)
    fields = [f"c{i}" for i in range(len(header))]
    row = F.from_csv("text", ", ".join(f"{f} string" for f in fields), FIELDS)
    rows = records(spark, path).withColumn("row", row)
    found = F.array(*[F.col("row")[f] for f in fields])
    named = F.array(*[F.lit(h or None).cast("string") for h in header])
    other = F.raise_error(F.concat(F.lit("another header than "), F.lit(str(header)), F.lit(" in "), F.col("file")))
    kept = rows.where(F.when(F.col("place").isNotNull(), True).when(found.eqNullSafe(named), False).otherwise(other.cast("boolean")))
    bad = (field_count(F.col("text")) > len(header)) | opens(F.col("text"))
    return kept.select(
        *[F.when(~bad, F.col("row")[f]).alias(n) for f, n in zip(fields, schema.names, strict=True)],
        F.col("place").alias(ROW_ID),
        F.when(bad, F.col("text")).alias(BAD_RECORD),
    )


def read_leads(spark: SparkSession, path: str) -> DataFrame:
    """Leads of the CSV files at ``path``, numbered without gaps in order of file names and rows.

    Fields may hold line breaks; large files are read by many tasks all the same. Rows with more
    fields than the header are kept with nothing but their number; ``bad_records`` lists them.
    """
    return parsed(spark, path)


def bad_records(leads: DataFrame) -> DataFrame:
    """``_row_id`` and text of the records that do not fit their header."""
    return leads.where(F.col(BAD_RECORD).isNotNull()).select(ROW_ID, BAD_RECORD)


def write_csv(df: DataFrame, path: str, ordered: bool = False) -> None:
    """Classified rows as CSV part files.

    ``ordered`` keeps the input order over the part files, by a range sort on
    the row number: nothing is gathered in one task.
    """
    if ordered:
        df = df.orderBy(ROW_ID)
    output_projection(df).write.mode("overwrite").options(**CSV_FORMAT).csv(path)


def split_path(path: str, decision: str) -> str:
    """``out.csv`` becomes ``out_PASS.csv``."""
    folder, slash, name = path.rpartition("/")
    base, dot, ext = name.rpartition(".")
    if not base:
        base, dot, ext = name, "", ""
    return f"{folder}{slash}{base}_{decision}{dot}{ext}"


def write_outputs(
    df: DataFrame, path: str, ordered: bool = False, stage: str | None = None
) -> DataFrame:
    """Write all rows and the PASS, FAIL and REVIEW rows; return the summary.

    The rows are computed once, into Parquet partitioned by decision at ``stage`` (by
    default a new place in the shared folder, to be emptied with that folder); the four
    outputs and the counts read that table, each split only its own partition.
    """
    spark = df.sparkSession
    stage = stage or scratch_path(spark, "classified")
    names = df.columns
    by_decision = df.withColumn("_decision", F.col("filter_decision"))
    by_decision.write.mode("overwrite").partitionBy("_decision").parquet(stage)
    schema = StructType([*df.schema.fields, StructField("_decision", StringType())])
    staged = spark.read.schema(schema).parquet(stage)
    write_csv(staged.select(*map(quoted, names)), path, ordered)
    for decision in DECISIONS:
        part = staged.where(F.col("_decision") == decision).select(*map(quoted, names))
        write_csv(part, split_path(path, decision), ordered)
    return decision_summary(staged)


def read_output(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a written output, every value a string, missing values empty."""
    return parsed(spark, path).drop(ROW_ID, BAD_RECORD).na.fill("")


def recount(spark: SparkSession, path: str) -> DataFrame:
    """``total, pass, fail, review`` counted from a written output, record by record."""
    rows = read_output(spark, path)
    return decision_summary(rows).select("total", "pass", "fail", "review")

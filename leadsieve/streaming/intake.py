"""Incremental intake: lead files that arrive in a folder are classified batch by batch.

Every micro-batch is the batch job over the new files. Pages are reduced to facts once, before the stream
starts, so a small batch does not read the whole snapshot again. Probe answers come from a maintained table
(``leadsieve.streaming.answers``), of which a batch reads only the buckets its URLs are in, or from a plain
log. What a batch settles on its way is removed when it is done.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leadsieve.config import SieveConfig
from leadsieve.operators.leads import (
    ROW_ID,
    distinct_urls,
    unify_headers,
    with_working_columns,
)
from leadsieve.operators.pages import of_sites, page_facts
from leadsieve.operators.report import decision_counts, histogram_of_counts, summary_of_counts
from leadsieve.plans.qualify import BROADCAST_ROW_BYTES, broadcast_limit, qualify
from leadsieve.sources.csv import CSV_INPUT, header_of, leads_schema
from leadsieve.sources.storage import exists, scratch_scope, settled
from leadsieve.streaming.answers import BUCKETS, last_batch, read_answers


# Number of the micro-batch that a row came with.
BATCH = "_batch"


def store_facts(snapshot: DataFrame, config: SieveConfig, path: str, use_api: bool = False):
    """Reduce a snapshot to one row per site and keep it as a Parquet table."""
    page_facts(snapshot, config, use_api).write.mode("overwrite").parquet(path)
    return snapshot.sparkSession.read.parquet(path)


def read_lead_stream(
    spark: SparkSession, folder: str, header: list[str] | None = None, files_per_batch: int = 1000
) -> DataFrame:
    """Lead files as a stream; the header is fixed, by default that of the files present."""
    schema = leads_schema(spark, header or header_of(spark, folder))
    return (
        spark.readStream.options(**CSV_INPUT)
        .option("multiLine", True)
        .option("maxFilesPerTrigger", files_per_batch)
        .schema(schema)
        .csv(folder)
    )


def batch_urls(leads: DataFrame) -> DataFrame:
    return distinct_urls(with_working_columns(unify_headers(leads)))


def answers_for(leads: DataFrame, probe_log: DataFrame) -> DataFrame:
    """The part of a plain probe log that a batch needs, if its URLs fit a broadcast."""
    urls = batch_urls(leads)
    fits = urls.count() * BROADCAST_ROW_BYTES <= broadcast_limit(leads)
    return of_sites(probe_log, probe_log["url"], urls, fits)


def _pinned(spark: SparkSession, path: str, current: int | None) -> int | None:
    """The number that was stored at ``path`` first: ``current`` now, the same one when a batch is run again."""
    if not exists(spark, f"{path}/_SUCCESS"):
        spark.createDataFrame([(current,)], "batch long").write.mode("overwrite").parquet(path)
    return spark.read.schema("batch long").parquet(path).first()[0]


def start_intake(
    stream: DataFrame,
    probe_log: DataFrame | str,
    facts: DataFrame,
    config: SieveConfig,
    output: str,
    checkpoint: str,
    buckets: int = BUCKETS,
    **options,
) -> StreamingQuery:
    """Classify what is new and stop.

    ``probe_log`` is a table or the path of a maintained table of answers. Batch n writes
    ``output/rows/batch=n/filter_decision=...`` and ``output/counts/batch=n``. A batch that is run again after a
    failure replaces its own folders, so every row is written and counted exactly once; it sees the answers
    that it saw first.
    """

    def classify(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        with scratch_scope(spark):
            # settled once: sizes, URLs and the join back all read this copy, not the files; a file is one task, so
            # its rows are dealt to all cores
            cores = spark.sparkContext.defaultParallelism
            leads = settled(batch.withColumn(ROW_ID, F.monotonically_increasing_id()).repartition(cores), "leads")
            if isinstance(probe_log, str):
                seen = _pinned(spark, f"{output}/answers/batch={number}", last_batch(spark, probe_log))
                log = read_answers(spark, probe_log, settled(batch_urls(leads), "batch_urls"), (-1 if seen is None else seen) + 1, buckets)
            else:
                log = answers_for(leads, probe_log)
            done = qualify(leads, log, config=config, facts=facts, **options)
            rows = f"{output}/rows/batch={number}"
            done.withColumn("split", F.col("filter_decision")).write.mode("overwrite").partitionBy(
                "split"
            ).parquet(rows)
            written = spark.read.schema("filter_decision string, industry_match string").parquet(rows)
            decision_counts(written).write.mode("overwrite").parquet(f"{output}/counts/batch={number}")

    return (
        stream.writeStream.foreachBatch(classify)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def classified_rows(spark: SparkSession, output: str) -> DataFrame:
    """All rows written so far; ``_batch`` and ``_row_id`` together number them."""
    rows = spark.read.parquet(f"{output}/rows").drop("split")
    return rows.withColumn(BATCH, F.col("batch").cast("long")).drop("batch")


def _counts(spark: SparkSession, output: str) -> DataFrame:
    schema = "industry_match string, filter_decision string, row_count long, batch long"
    return spark.read.schema(schema).parquet(f"{output}/counts")


def batch_summaries(spark: SparkSession, output: str) -> DataFrame:
    """One summary per batch."""
    return summary_of_counts(_counts(spark, output), "batch")


def running_summary(spark: SparkSession, output: str) -> DataFrame:
    """The summary of all rows so far, added up from the batches' counts; no row is read again."""
    return summary_of_counts(_counts(spark, output))


def running_histogram(spark: SparkSession, output: str) -> DataFrame:
    """Rows and percent per match result so far, as ``match_histogram`` of all rows."""
    return histogram_of_counts(_counts(spark, output))

"""Probe answers as maintained state: a bucketed table that batches of answers are merged into.

The table holds the answers that count, one per URL and request, in ``buckets`` by a hash of the URL. Merging
batch n reads the buckets that its URLs are in, keeps the answers that win (the latest by ``probed_at``,
however late it arrives) and writes these buckets anew below ``data/batch=n``; the others stay where
they are. A log of the buckets each batch has written is what publishes it, so a batch that failed half way is not seen.
A batch that is run again starts from the batches before it and replaces its own folders: any replay gives the
same table. Reading for some URLs touches only their buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leadsieve.operators.probes import ATTEMPTS, pivot_probes
from leadsieve.sources.storage import delete, exists, scratch_scope, settled

#: Buckets of a table. The list of those that a batch touches is all that the driver sees of it.
BUCKETS = 1024

_ANSWER = "probed_at timestamp, status_code int, final_url string, error_kind string, error_text string"
_SCHEMA = f"url string, attempt string, {_ANSWER}"


def bucket_of(url: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(buckets)).cast("int")


def _versions(spark: SparkSession, path: str, before: int | None) -> dict[int, int]:
    """Per bucket the last batch that wrote it, of those numbered below ``before``."""
    if not exists(spark, f"{path}/log"):
        return {}
    log = spark.read.schema("bucket int, batch long").parquet(f"{path}/log")
    if before is not None:
        log = log.where(F.col("batch") < before)
    return {r.bucket: r.batch for r in log.groupBy("bucket").agg(F.max("batch").alias("batch")).collect()}


def last_batch(spark: SparkSession, path: str) -> int | None:
    """The number of the last batch that is in the table."""
    return max(_versions(spark, path, None).values(), default=None)


def winners(answers: DataFrame) -> DataFrame:
    """The answers that count, one per URL and request, by the rule of ``pivot_probes``."""
    each = [F.struct(F.lit(attempt).alias("attempt"), F.col(name).alias("answer")) for name, attempt in ATTEMPTS.items()]
    rows = pivot_probes(answers).select("url", F.inline(F.array(*each))).where("answer IS NOT NULL")
    return rows.select("url", "attempt", "answer.*")


def read_answers(
    spark: SparkSession, path: str, urls: DataFrame | None = None, before: int | None = None, buckets: int = BUCKETS
) -> DataFrame:
    """The table, or the buckets of it that the column ``url`` of ``urls`` is in.

    ``before`` leaves out that batch and all later ones.
    """
    versions = _versions(spark, path, before)
    wanted = set(versions)
    if urls is not None:
        touched = urls.select(bucket_of(F.col("url"), buckets).alias("b")).where("b IS NOT NULL").distinct().collect()
        wanted &= {r.b for r in touched}
    folders = [f"{path}/data/batch={versions[b]}/bucket={b}" for b in sorted(wanted)]
    if not folders:
        return spark.createDataFrame([], _SCHEMA)
    return spark.read.schema(_SCHEMA).parquet(*folders)


def merge_answers(path: str, answers: DataFrame, batch: int, buckets: int = BUCKETS) -> None:
    """Merge ``answers`` (a probe log, ``probed_at`` optional) as batch number ``batch``."""
    spark = answers.sparkSession
    if "probed_at" not in answers.columns:
        answers = answers.withColumn("probed_at", F.lit(None).cast("timestamp"))
    with scratch_scope(spark):
        new = settled(winners(answers.select("url", "attempt", *[f.split()[0] for f in _ANSWER.split(", ")])), "answers")
        old = read_answers(spark, path, new, batch, buckets)
        merged = winners(old.unionByName(new)).withColumn("bucket", bucket_of(F.col("url"), buckets))
        data = f"{path}/data/batch={batch}"
        delete(spark, f"{path}/log/batch={batch}")
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(data)
        touched = new.select(bucket_of(F.col("url"), buckets).alias("bucket")).distinct()
        touched.coalesce(1).write.mode("overwrite").parquet(f"{path}/log/batch={batch}")


def forget_before(spark: SparkSession, path: str, batch: int) -> int:
    """Delete the bucket folders that no reader from ``batch`` on needs; returns how many."""
    needed = _versions(spark, path, batch)
    log = spark.read.schema("bucket int, batch long").parquet(f"{path}/log").where(F.col("batch") < batch)
    old = [(r.batch, r.bucket) for r in log.toLocalIterator() if needed[r.bucket] != r.batch]
    gone = 0
    for b, bucket in old:
        folder = f"{path}/data/batch={b}/bucket={bucket}"
        if exists(spark, folder):
            delete(spark, folder)
            gone += 1
    return gone


def start_answer_intake(stream: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Merge the answers that are new in ``stream`` into the table at ``path`` and stop."""

    def merge(batch: DataFrame, number: int) -> None:
        merge_answers(path, batch, number, buckets)

    return (
        stream.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

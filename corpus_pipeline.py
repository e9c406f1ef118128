"""From raw documents to packed training sequences, stage by stage.

Every stage is a function ``(spark, docs, sf_dir) -> DataFrame`` that works on all rows its
predecessor kept; all but the last return the columns of ``documents``. ``run`` writes each
result as Parquet to the shared folder and reads it again as the next stage's input.

Rows without ``doc_id`` stay: no stage can name them, so none rejects them. ``n_chars``
follows the text where a stage changes it. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadsieve.llm import toxicity
from leadsieve.llm.decontaminate import decontaminated
from leadsieve.llm.line_dedup import line_dedup
from leadsieve.llm.near_dedup import near_dedup
from leadsieve.llm.packing import packed
from leadsieve.llm.tables import read_table
from leadsieve.sources.storage import scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``doc_id`` is not in ``rejected``."""
    return docs.select(*COLUMNS).join(rejected.select("doc_id"), "doc_id", "left_anti").select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of all labelled rows calls toxic go."""
    model = toxicity.fitted(docs, read_table(spark, sf_dir, "labels"))
    return without(docs, toxicity.scored(docs, model).where("predicted = 1"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-equal lines the first stays; a document goes if all its words did."""
    document = F.col("document")
    cleaned = line_dedup(docs.select(*COLUMNS))
    emptied = (F.col("lines")["n_removed"] > 0) & (F.trim(F.translate(document["text"], "\n\r\t", "   ")) == "")
    return cleaned.where(~F.coalesce(emptied, F.lit(False))).select(
        *[document[c].alias(c) for c in COLUMNS if c != "n_chars"],
        F.when(F.col("lines")["n_removed"] > 0, F.length(document["text"]))
        .otherwise(document["n_chars"])
        .cast(docs.schema["n_chars"].dataType)
        .alias("n_chars"),
    )


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id."""
    return without(docs, near_dedup(docs).where("NOT kept"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return without(docs, decontaminated(docs, read_table(spark, sf_dir, "benchmark")).where("n_hit > 0"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences of 1024 tokens."""
    return packed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Not expressible: the first stage fits a model and the last one needs a tokeniser.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

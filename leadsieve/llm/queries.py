"""The registered queries of the operators and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from leadsieve.llm import language_model, sql
from leadsieve.llm.centroids import clustered, with_inertia
from leadsieve.llm.decontaminate import decontaminated
from leadsieve.llm.exact_dedup import exact_dedup
from leadsieve.llm.language_id import dictionaries, predicted, training_passages
from leadsieve.llm.lexical_search import lexical_search
from leadsieve.llm.line_dedup import line_dedup
from leadsieve.llm.near_dedup import near_dedup
from leadsieve.llm.packing import packed
from leadsieve.llm.secrets import count_of, secrets, spans_of
from leadsieve.llm.simhash import simhash_dedup
from leadsieve.llm.tables import read_table
from leadsieve.llm.toxicity import fitted, id_bucket, scored
from leadsieve.llm.url_filter import judged


def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(read_table(spark, sf_dir, "pages"))


def exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"))


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(read_table(spark, sf_dir, "documents"))


def near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(read_table(spark, sf_dir, "documents"), width=3, percent=85)


def fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup(read_table(spark, sf_dir, "documents"))
    return cleaned.select("document.doc_id", "lines.n_lines", "lines.n_removed", "document.text")


def toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    held_out = id_bucket(F.col("doc_id"), 5) == 0
    model = fitted(documents, labels.where(~held_out))
    return scored(documents, model).select(
        "doc_id", held_out.alias("held_out"), "score", "predicted", "evidence", "n_tokens", "passages"
    )


def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    held_out = id_bucket(F.col("doc_id"), 3) == 1
    learned = dictionaries(training_passages(documents.where(~held_out)))
    return predicted(documents, learned).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score", "margin", "rejected"
    )


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(read_table(spark, sf_dir, "documents")).select(
        "doc_id",
        *[count_of("found", k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(spans_of("found", True).cast("binary"), 256).alias("base_sha256"),
        spans_of("found", False).alias("spans"),
    )


def lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    held_out = id_bucket(F.col("doc_id"), 7) == 2
    return language_model.scored(documents, documents.where(~held_out)).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(read_table(spark, sf_dir, "documents"))


def clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_inertia(*clustered(read_table(spark, sf_dir, "embeddings")))


QUERIES = {
    "op1_lm_scores": lm_scores,
    "op2_secret_scan": secret_scan,
    "op3_language_id": language,
    "op4_minhash_near_dedup": near,
    "op5_toxicity": toxic,
    "op6_url_filter": url_filter,
    "op7_best_fit_packing": packing,
    "op8_exact_dedup": exact,
    "op9_decontamination": decontamination,
    "op10_fuzzy_line_dedup": fuzzy_lines,
    "op11_lexical_search": search,
    "op12_simhash_near_dedup": simhash,
    "op13_centroid_clustering": clustering,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL = sql.STATEMENTS

"""Nulls, empty and long texts, repeated rows, empty tables and clashing column names, for every operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from leadsieve.llm import language_model, toxicity
from leadsieve.llm.decontaminate import decontaminated
from leadsieve.llm.exact_dedup import exact_dedup
from leadsieve.llm.language_id import dictionaries, predicted, training_passages
from leadsieve.llm.line_dedup import line_dedup
from leadsieve.llm.near_dedup import near_dedup
from leadsieve.llm.packing import packed
from leadsieve.llm.secrets import secrets
from leadsieve.llm.url_filter import judged
from tests.llm.conftest import EDGES

CLASHING = ["row", "id", "a", "b", "kind", "key", "n", "value", "component", "removed", "document", "with `tick`.dot"]


def _benchmark(docs):
    return docs.sparkSession.createDataFrame([(1, "here again"), (2, ""), (3, None)], "item_id long, text string")


def _labels(docs):
    rows = [(5, 1), (7, 0), (None, 1), (4, None)]
    return docs.sparkSession.createDataFrame(rows, "doc_id long, toxic int")


OPERATORS = {
    "lm_scores": lambda d: language_model.scored(d, d),
    "secrets": secrets,
    "language": lambda d: predicted(d, dictionaries(training_passages(d))),
    "near_dedup": near_dedup,
    "toxicity": lambda d: toxicity.scored(d, toxicity.fitted(d, _labels(d))),
    "exact_dedup": exact_dedup,
    "decontamination": lambda d: decontaminated(d, _benchmark(d)),
    "line_dedup": line_dedup,
    "urls": lambda d: judged(d.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_document(documents, name):
    docs = documents(EDGES)
    for column in CLASHING:
        docs = docs.withColumn(column, F.lit(1))
    assert len(OPERATORS[name](docs).collect()) == len(EDGES)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(documents, name):
    assert OPERATORS[name](documents([])).collect() == []


def test_packing(documents):
    docs = documents(EDGES).withColumn("row", F.lit(1)).withColumn("p", F.lit(1))
    rows = packed(docs).collect()
    assert len([r for r in rows if r.piece == 0]) == len(EDGES)
    assert sorted((r.length, r.piece) for r in rows if r.doc_id in (1, 2)) == [(1, 0), (1, 0)]
    assert packed(documents([])).collect() == []


def test_stages(spark, documents, tmp_path):
    docs = documents(EDGES)
    _benchmark(docs).write.parquet(f"{tmp_path}/benchmark.parquet")
    _labels(docs).write.parquet(f"{tmp_path}/labels.parquet")
    for table in (docs, documents([])):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, table.withColumn("extra", F.lit(1)), str(tmp_path))
            assert kept.columns == corpus_pipeline.COLUMNS, name
            assert kept.where("doc_id IS NULL").count() == table.where("doc_id IS NULL").count(), name


def test_defined_results(documents):
    docs = documents(EDGES)
    exact = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(docs).collect()}
    assert {(1, 2, 2, False), (2, 2, 2, True), (5, 6, 3, False), (6, 6, 3, True), (None, None, 1, True)} <= exact
    near = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup(docs).collect()}
    assert near[1] == (0, 1, True) and near[2] == (0, 2, True) and near[4] == (1, 4, True)
    assert near[5] == (4, 5, True) and near[6] == (4, 5, False) and near[None][1:] == (None, True)
    found = {r.doc_id: r for r in decontaminated(docs, _benchmark(docs)).collect()}
    assert found[5].n_hit == 2 and found[5]["items"] == ["1"] and found[1].n_words == 0
    langs = {r.doc_id: r for r in predicted(docs, (("xx", b" word end "),)).collect()}
    assert langs[1].lang_pred == "und" and langs[3].lang_pred == "und" and langs[4].lang_pred == "xx"

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from leadsieve import qualify
from leadsieve.operators.leads import ROW_ID
from leadsieve.operators.report import decision_summary, match_histogram
from leadsieve.sources.storage import shared_dir
from leadsieve.streaming.answers import (
    forget_before,
    last_batch,
    merge_answers,
    read_answers,
    start_answer_intake,
    winners,
)
from leadsieve.streaming.intake import (
    batch_summaries,
    classified_rows,
    read_lead_stream,
    running_histogram,
    running_summary,
    start_intake,
    store_facts,
)
from leadsieve.streaming import intake
from tests.test_qualify import CFG, inputs
from workload import spark_queries

HEADER = "company_name,domain,website\n"


def plain(frame):
    return sorted(tuple("" if v is None else v for v in r) for r in frame.drop(ROW_ID).collect())


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    leads, log, pages = inputs(spark)
    folder, out, progress = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "progress")
    folder.mkdir()
    lines = [",".join(v or "" for v in r) for r in leads.collect()]
    facts = store_facts(pages, CFG, str(tmp_path / "facts"))

    def run():
        stream = read_lead_stream(spark, str(folder), files_per_batch=1)
        start_intake(stream, log, facts, CFG, out, progress).awaitTermination()

    (folder / "1.csv").write_text(HEADER + "\n".join(lines[:4]))
    (folder / "2.csv").write_text(HEADER + "\n".join(lines[4:7]))
    run()
    assert classified_rows(spark, out).count() == 7
    run()
    assert classified_rows(spark, out).count() == 7
    (folder / "3.csv").write_text(HEADER + "\n".join(lines[7:]))
    run()
    got = classified_rows(spark, out)
    batch = qualify(leads, log, pages, CFG)
    assert plain(got.select(batch.columns)) == plain(batch)
    summaries = batch_summaries(spark, out)
    assert summaries.count() == 3
    assert tuple(summaries.selectExpr("sum(total)", "sum(pass)", "sum(fail)", "sum(review)").first()) == (10, 2, 5, 3)


def test_running_totals_equal_the_batch_job_even_if_a_batch_is_repeated(spark, tmp_path):
    leads, log, pages = inputs(spark)
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    lines = [",".join(v or "" for v in r) for r in leads.collect()]
    facts = store_facts(pages, CFG, str(tmp_path / "facts"))
    for i, (a, b) in enumerate(((0, 4), (4, 10))):
        (folder / f"{i}.csv").write_text(HEADER + "\n".join(lines[a:b]))

    def run(progress):
        stream = read_lead_stream(spark, str(folder), files_per_batch=1)
        start_intake(stream, log, facts, CFG, out, str(tmp_path / progress)).awaitTermination()

    before = set(os.listdir(shared_dir(spark).removeprefix("file:")))
    run("first")
    run("first")
    once = running_summary(spark, out).collect(), running_histogram(spark, out).collect()
    run("second")  # both batches again, into the same folders
    assert (running_summary(spark, out).collect(), running_histogram(spark, out).collect()) == once
    left = set(os.listdir(shared_dir(spark).removeprefix("file:"))) - before
    assert not [x for x in left if x.startswith("leadsieve-")]  # nothing that the batches settled
    done = qualify(leads, log, pages, CFG)
    assert [tuple(r) for r in once[0]] == [tuple(r) for r in decision_summary(done).collect()]
    assert [tuple(r) for r in once[1]] == [tuple(r) for r in match_histogram(done).collect()]


def answer(url, attempt="head_https", status=200, at=1, final=None):
    return (url, attempt, datetime(2024, 1, at) if at else None, status, final or url, None, None)


ANSWERS = "url string, attempt string, probed_at timestamp, status_code int, final_url string, error_kind string, error_text string"


def test_answers_are_merged_by_time_and_replays_change_nothing(spark, tmp_path):
    path = str(tmp_path / "answers")
    urls = [f"https://s{i}.com" for i in range(40)]
    batches = [
        [answer(u, at=5) for u in urls[:20]] + [answer(u, "get", 404, at=2) for u in urls[:5]],
        [answer(u, status=500, at=3) for u in urls] + [answer(urls[0], status=301, at=9)] * 3,
        [answer(urls[1], status=204, at=6), answer(urls[2], status=418, at=None), (None, "get", None, 200, None, None, None)],
    ]
    whole = spark.createDataFrame([a for b in batches for a in b], ANSWERS)
    want = sorted(map(tuple, winners(whole).collect()), key=repr)
    frames = [spark.createDataFrame(b, ANSWERS) for b in batches]
    for number in (0, 0, 1, 1, 2):
        merge_answers(path, frames[number], number, 8)
    assert sorted(map(tuple, read_answers(spark, path, buckets=8).collect()), key=repr) == want
    kept = {(r.url, r.attempt): r.status_code for r in read_answers(spark, path, buckets=8).collect()}
    assert kept[urls[0], "head_https"] == 301 and kept[urls[1], "head_https"] == 204 and kept[urls[2], "head_https"] == 200
    assert kept[urls[30], "head_https"] == 500 and kept[urls[0], "get"] == 404
    # as it was before the last batch
    then = {(r.url, r.attempt): r.status_code for r in read_answers(spark, path, before=2, buckets=8).collect()}
    assert then[urls[1], "head_https"] == 200 and last_batch(spark, path) == 2
    # old folders go, the table stays
    assert forget_before(spark, path, 3) > 0
    assert sorted(map(tuple, read_answers(spark, path, buckets=8).collect()), key=repr) == want


def test_only_the_buckets_of_the_urls_are_read(spark, tmp_path):
    path = str(tmp_path / "answers")
    assert read_answers(spark, path).count() == 0
    merge_answers(path, spark.createDataFrame([answer(f"https://s{i}.com") for i in range(200)], ANSWERS), 0, 16)
    one = spark.createDataFrame([("https://s7.com",), ("https://unknown.com",), (None,)], "url string")
    part = read_answers(spark, path, one, buckets=16)
    folders = {f.rsplit("/", 2)[1] for f in part.inputFiles()}
    assert 1 <= len(folders) <= 2 and part.where("url = 'https://s7.com'").count() == 1
    assert len({f.rsplit("/", 2)[1] for f in read_answers(spark, path, buckets=16).inputFiles()}) == 16
    # a later batch writes its own buckets alone
    merge_answers(path, spark.createDataFrame([answer("https://s7.com", status=301, at=2)], ANSWERS), 1, 16)
    assert len(os.listdir(f"{path}/data/batch=1")) <= 3  # one bucket and the marks of the commit
    assert read_answers(spark, path, buckets=16).count() == 200


def test_a_batch_that_failed_half_way_is_not_seen(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "answers")
    merge_answers(path, spark.createDataFrame([answer("https://a.com")], ANSWERS), 0, 4)
    new = spark.createDataFrame([answer("https://a.com", status=301, at=2)], ANSWERS)
    failing = new.withColumn("final_url", F.when(F.rand() < 2, F.raise_error(F.lit("lost"))).otherwise(F.col("final_url")))
    with pytest.raises(Exception, match="lost"):
        merge_answers(path, failing, 1, 4)
    assert [r.status_code for r in read_answers(spark, path, buckets=4).collect()] == [200]
    merge_answers(path, new, 1, 4)
    assert [r.status_code for r in read_answers(spark, path, buckets=4).collect()] == [301]


def test_answers_from_a_stream(spark, tmp_path):
    path, folder = str(tmp_path / "answers"), str(tmp_path / "in")
    for i in range(3):
        spark.createDataFrame([answer(f"https://s{i}.com"), answer("https://a.com", status=200 + i, at=1 + i)], ANSWERS).write.mode(
            "append"
        ).parquet(folder)
        stream = spark.readStream.schema(ANSWERS).parquet(folder)
        start_answer_intake(stream, path, str(tmp_path / "progress"), 4).awaitTermination()
    kept = {r.url: r.status_code for r in read_answers(spark, path, buckets=4).collect()}
    assert kept == {"https://a.com": 202} | {f"https://s{i}.com": 200 for i in range(3)}


def test_splits_of_wide_tables_are_no_lead_files_of_their_own(spark, tmp_path):
    """Each batch takes a number of files and reads the stored facts, so their number must follow the leads' bytes."""
    docs = spark.range(64).selectExpr("id AS doc_id", "repeat('x', 100) AS text", "'en' AS lang", "'s' AS source")
    docs.repartition(16).write.parquet(str(tmp_path / "documents.parquet"))
    pages = spark.range(8).selectExpr("id AS page_id", "'u' AS url", "'<p>y</p>' AS html")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "2000")
    try:
        folder = spark_queries._lead_files(spark, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    files = [f for f in os.listdir(folder.removeprefix("file:")) if f.endswith(".csv")]
    assert len(files) == 1
    assert spark.read.option("header", True).csv(folder).count() == 72


def test_rows_of_one_file_are_dealt_to_all_cores(spark, tmp_path, monkeypatch):
    """A CSV file with line breaks in fields is read by one task; what follows is not."""
    leads, log, pages = inputs(spark)
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.csv").write_text(HEADER + "".join(f"n{i},h{i}.example.org,\n" for i in range(400)))
    facts = store_facts(pages, CFG, str(tmp_path / "facts"))
    settle, splits = intake.settled, []

    def counted(df, name="table"):
        table = settle(df, name)
        if name == "leads":
            splits.append(table.select(F.input_file_name()).distinct().count())
        return table

    monkeypatch.setattr(intake, "settled", counted)
    stream = read_lead_stream(spark, str(folder))
    start_intake(stream, log, facts, CFG, str(tmp_path / "out"), str(tmp_path / "progress")).awaitTermination()
    assert splits == [spark.sparkContext.defaultParallelism]
    assert classified_rows(spark, str(tmp_path / "out")).count() == 400

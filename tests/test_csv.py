import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from leadsieve.operators.leads import ROW_ID, unify_headers
from leadsieve.sources.csv import (
    BAD_RECORD,
    bad_records,
    parsed,
    read_leads,
    read_output,
    recount,
    split_path,
    write_csv,
    write_outputs,
)
from tests.test_qualify import CFG, inputs, rows
from leadsieve import qualify
from workload import spark_queries


def lead_file(tmp_path, content, name="leads.csv"):
    path = tmp_path / name
    path.write_bytes(content.encode("utf-8"))
    return str(path)


def test_read_leads(spark, tmp_path):
    path = lead_file(
        tmp_path,
        'company_name,domain,Note\r\n"A ""quoted"", Inc.", a.com ,"two\nlines"\r\n\r\n'
        "short\r\nlong,b.com,n,surplus\r\n007,,\r\n",
    )
    frame = read_leads(spark, path)
    assert frame.columns == ["company_name", "domain", "Note", ROW_ID, BAD_RECORD]
    assert {f.dataType.simpleString() for f in frame.schema.fields[:3]} == {"string"}
    assert rows(frame.drop(BAD_RECORD)) == [
        ('A "quoted", Inc.', " a.com ", "two\nlines"),
        ("short", None, None),
        (None, None, None),
        ("007", None, None),
    ]
    assert [r[ROW_ID] for r in frame.orderBy(ROW_ID).collect()] == [0, 1, 2, 3]
    assert [tuple(r) for r in bad_records(frame).collect()] == [(2, "long,b.com,n,surplus")]


def python_rows(paths):
    """What Python's own reader makes of the files, in order, and which rows have too many fields."""
    out = []
    for path in sorted(paths):
        with open(path, encoding="utf-8-sig") as f:
            header, *rows = [r for r in csv.reader(f) if r]
        for r in rows:
            bad = len(r) > len(header)
            out.append((bad, [None] * len(header) if bad else [x or None for x in r] + [None] * (len(header) - len(r))))
    return out


@pytest.mark.parametrize(("size", "ending"), [(40, "\n"), (97, "\r\n"), (1000, "\r")])
def test_files_cut_anywhere_give_the_same_rows(spark, tmp_path, size, ending):
    """Splits of a few bytes begin inside quotes, between quotes and between fields."""
    rng = random.Random(size)
    parts = ["a", "b c", '"', '""', ",", "\n", "\n\n", "ü", " ", ",\n", '",\n"', "x" * 30]
    paths = []
    for k in range(3):
        rows = [["n", "text", "z"]]
        for i in range(60):
            row = [f"{k}.{i}", "".join(rng.choices(parts, k=rng.randint(0, 7))), rng.choice(["", "z"])]
            rows.append(row[: rng.choice([1, 2, 3, 3, 3])] if rng.random() < 0.9 else [*row, "surplus"])
        text = io.StringIO()
        csv.writer(text, lineterminator="\n").writerows(rows)
        text = text.getvalue().replace("\n2.7", "\n\n2.7") + ('5" pipe,3" x' if k else "")
        paths.append(tmp_path / f"{k}.csv")
        paths[-1].write_bytes(text.replace("\n", ending).encode("utf-8-sig" if k % 2 else "utf-8"))
    want = python_rows(paths)
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        frame = read_leads(spark, str(tmp_path))
        got = sorted((r[ROW_ID], r[BAD_RECORD] is not None, list(r)[:3]) for r in frame.collect())
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert [g[0] for g in got] == list(range(len(want)))
    assert [(bad, row) for _, bad, row in got] == want


def test_a_large_file_is_many_tasks(spark, tmp_path):
    with open(tmp_path / "big.csv", "w") as f:
        f.write("n,text\n")
        for i in range(60_000):
            f.write(f'{i},"line one of {i}\nline, two ""of"" it"\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
        frame = read_leads(spark, str(tmp_path))
        blocks = spark.read.text(str(tmp_path)).select("_metadata.file_block_start").distinct().count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert blocks > 8
    wrong = frame.where((F.col("n").cast("long") != F.col(ROW_ID)) | ~F.col("text").endswith('two "of" it'))
    assert frame.count() == 60_000 and wrong.count() == 0


def test_an_open_quote_takes_the_rest_of_its_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1,"open\n2,b\n3,c')
    (tmp_path / "b.csv").write_text("x,y\n4,d\n")
    got = read_leads(spark, str(tmp_path)).orderBy(ROW_ID).collect()
    assert [(r.x, r[BAD_RECORD]) for r in got] == [(None, '1,"open\n2,b\n3,c'), ("4", None)]


def test_empty_files_and_headers_alone(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n")
    (tmp_path / "b.csv").write_text("")
    (tmp_path / "c.csv").write_text("\n\nx,y\n\n1,2")
    assert [tuple(r)[:3] for r in read_leads(spark, str(tmp_path)).collect()] == [("1", "2", 0)]


def test_byte_order_mark_and_folder(spark, tmp_path):
    lead_file(tmp_path, "﻿domain,x\na.com,1\n", "1.csv")
    lead_file(tmp_path, "﻿domain,x\nb.com,2\nc.com,3\n", "2.csv")
    frame = read_leads(spark, str(tmp_path))
    assert frame.columns == ["domain", "x", ROW_ID, BAD_RECORD]
    assert sorted(r.domain for r in frame.collect()) == ["a.com", "b.com", "c.com"]
    assert frame.select(ROW_ID).distinct().count() == 3


def test_headers_that_differ_in_case(spark, tmp_path):
    path = lead_file(tmp_path, "Domain,domain\nA.com,b.com\n")
    with pytest.raises(ValueError, match="caseSensitive"):
        read_leads(spark, path)
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        assert rows(read_leads(spark, path).drop(BAD_RECORD)) == [("A.com", "b.com")]
    finally:
        spark.conf.unset("spark.sql.caseSensitive")


def test_split_path():
    assert split_path("/x.y/out.csv", "PASS") == "/x.y/out_PASS.csv"
    assert split_path("out", "FAIL") == "out_FAIL"
    assert split_path("/a/.hidden", "FAIL") == "/a/.hidden_FAIL"


def test_outputs_partition_the_input(spark, tmp_path):
    leads, log, pages = inputs(spark, copies=3)
    done = qualify(leads, log, pages, CFG)
    out = str(tmp_path / "out.csv")
    summary = write_outputs(done, out, ordered=True)
    assert tuple(summary.first())[:4] == (30, 6, 15, 9)
    assert tuple(recount(spark, out).first()) == (30, 6, 15, 9)
    whole = read_output(spark, out)
    assert "_row_id" not in whole.columns and "is_parked" not in whole.columns
    parts = [read_output(spark, split_path(out, d)).collect() for d in ("PASS", "FAIL", "REVIEW")]
    assert [len(p) for p in parts] == [6, 15, 9]
    assert sorted(map(tuple, whole.collect())) == sorted(tuple(r) for p in parts for r in p)
    want = [tuple("" if v is None else str(v) for v in r) for r in rows(done)]
    assert [tuple(r) for r in parsed(spark, out).orderBy(ROW_ID).select(whole.columns).na.fill("").collect()] == want


def test_recount_is_not_misled_by_text(spark, tmp_path):
    leads, log, pages = inputs(spark)
    done = qualify(leads, log, pages, CFG)
    tricky = done.withColumn("scraped_text", F.lit('a,FAIL,\n"b",PASS,\n x \\ " '))
    out = str(tmp_path / "tricky")
    write_csv(tricky, out)
    assert tuple(recount(spark, out).first()) == (10, 2, 5, 3)
    assert {r.scraped_text for r in read_output(spark, out).collect()} == {'a,FAIL,\n"b",PASS,\n x \\ " '}


def test_files_with_other_headers_fail(spark, tmp_path):
    (tmp_path / "a.csv").write_text("company_name,domain\nAcme,acme.com\n")
    (tmp_path / "b.csv").write_text("domain,company_name\nbeta.com,Beta\n")
    with pytest.raises(Exception, match="header"):
        read_leads(spark, str(tmp_path)).collect()


def test_a_header_with_line_breaks_and_backticks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('company_name,"dom\nain","a`b"\nAcme,x,1\n')
    rows = read_leads(spark, str(tmp_path))
    assert rows.columns[:3] == ["company_name", "dom\nain", "a`b"]
    assert unify_headers(rows).collect()[0][2] == "1"


@pytest.mark.parametrize("header", ["company_name,Domain,website", "Company_Name,Company Name,domain", "company_name,domain,Industry_Match"])
def test_columns_that_differ_in_case_alone_are_not_overwritten(spark, tmp_path, header):
    (tmp_path / "a.csv").write_text(f"{header}\nx,y,z\n")
    with pytest.raises(ValueError, match="caseSensitive"):
        unify_headers(read_leads(spark, str(tmp_path)))
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        row = unify_headers(read_leads(spark, str(tmp_path))).first().asDict()
        assert [row[c] for c in header.split(",")] == ["x", "y", "z"]
    finally:
        spark.conf.unset("spark.sql.caseSensitive")


def test_no_written_file_grows_with_the_documents(spark, tmp_path, monkeypatch):
    """All in one folder: its rows are ranges of several tasks, in order, and every file begins with the header."""
    n = 4000
    docs = spark.range(n).selectExpr("id * 8 AS doc_id", "repeat(concat('a\"b', id, '\n'), 3) AS text", "'s' AS source")
    docs.repartition(6).write.parquet(str(tmp_path / "documents.parquet"))
    folder = str(tmp_path / "out")
    monkeypatch.setattr(spark_queries, "scratch_path", lambda session, name: folder)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark_queries.csv_records(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = [p.read_text() for p in sorted((tmp_path / "out" / "p=0").glob("*.txt"))]
    assert len(files) > 1 and max(map(len, files)) < 0.6 * sum(map(len, files))
    assert all(f.startswith("company_name,domain,website\n") and f.count("company_name") == 1 for f in files)
    rows.sort(key=lambda r: r.place)
    assert [r.place for r in rows] == list(range(n))
    assert [r.doc for r in rows] == [None if i * 8 % 7 == 3 else str(i * 8) for i in range(n)]
    assert all((r.bad_md5 is None) == (r.doc is not None) for r in rows)

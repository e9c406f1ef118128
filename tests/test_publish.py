import pytest

from leadsieve import qualify
from leadsieve.sources import csv, publish
from leadsieve.sources.publish import (
    forget_versions,
    publish_outputs,
    published,
    read_published,
    recount_published,
)
from tests.test_qualify import CFG, inputs


def test_a_job_killed_between_two_outputs_leaves_the_earlier_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "out")
    leads, log, pages = inputs(spark)
    with pytest.raises(ValueError, match="no such version"):
        published(spark, path)
    first = publish_outputs(qualify(leads, log, pages, CFG), path)
    assert tuple(first.first())[:4] == (10, 2, 5, 3) == tuple(recount_published(spark, path).first())
    assert {r.output: r.row_count for r in published(spark, path).collect()} == {"ALL": 10, "PASS": 2, "FAIL": 5, "REVIEW": 3}

    write, done = csv.write_csv, []

    def killed(df, place, ordered=False):
        if len(done) == 2:
            raise RuntimeError("lost")
        done.append(place)
        write(df, place, ordered)

    more = qualify(leads.unionAll(leads), log, pages, CFG)
    monkeypatch.setattr(csv, "write_csv", killed)
    with pytest.raises(RuntimeError, match="lost"):
        publish_outputs(more, path)
    assert len(done) == 2 and tuple(recount_published(spark, path).first()) == (10, 2, 5, 3)
    assert read_published(spark, path, "PASS").count() == 2

    monkeypatch.setattr(csv, "write_csv", write)
    publish_outputs(more, path)
    assert tuple(recount_published(spark, path).first()) == (20, 4, 10, 6)
    assert read_published(spark, path, "REVIEW").count() == 6
    assert published(spark, path, 0).count() == 4  # the earlier one can still be read
    assert forget_versions(spark, path, keep=1) == 2  # it, and what the killed job left
    assert tuple(recount_published(spark, path).first()) == (20, 4, 10, 6)
    with pytest.raises(ValueError):
        published(spark, path, 0)


def test_an_incomplete_manifest_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "out")
    leads, log, pages = inputs(spark)
    done = qualify(leads, log, pages, CFG)
    publish_outputs(done, path)
    (tmp_path / "out" / "manifest" / "1").mkdir()
    assert recount_published(spark, path).first().total == 10
    assert publish_outputs(done, path).first().total == 10 and published(spark, path).first().path.count("versions/2/") == 1

import os

from leadsieve.sources.storage import scratch_path, scratch_scope, settled, shared_dir


def folders(spark):
    root = shared_dir(spark).removeprefix("file:")
    return {f for f in os.listdir(root) if f.startswith("leadsieve-")}


def test_settled_tables_go_with_their_scope(spark):
    before = folders(spark)
    with scratch_scope(spark):
        table = settled(spark.range(5).selectExpr("id", "id * 2 AS twice"))
        with scratch_scope(spark):
            inner = settled(table.select("twice"))
            assert inner.count() == 5
        assert table.count() == 5 and table.columns == ["id", "twice"]
        assert len(folders(spark) - before) == 1
    assert folders(spark) == before
    kept = settled(spark.range(3))
    assert kept.count() == 3 and len(folders(spark) - before) == 1
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_a_failed_scope_is_removed_too(spark):
    before = folders(spark)
    try:
        with scratch_scope(spark):
            settled(spark.range(5))
            raise KeyError
    except KeyError:
        pass
    assert folders(spark) == before

"""What the plans must look like, whatever the data."""

import re

from leadsieve.config import candidate_paths
from leadsieve.operators.pages import (
    captures,
    chosen_pages,
    homepage_source,
    page_facts,
    reduce_homepages,
    reduce_subpages,
    subpage_numbers,
)
from leadsieve.plans.qualify import qualify
from tests.test_qualify import CFG, inputs


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def stored(spark, tmp_path, copies=1):
    """The inputs as files, so that scans and pruning show in the plan."""
    out = []
    for name, frame in zip(("leads", "log", "pages"), inputs(spark, copies)):
        frame.write.parquet(str(tmp_path / name))
        out.append(spark.read.parquet(str(tmp_path / name)))
    return out


def test_no_python_and_no_cross_join(spark, tmp_path):
    leads, log, pages = stored(spark, tmp_path, 3)
    for slice_rows in (2, 1000):
        text = plan(qualify(leads, log, pages, CFG, slice_rows=slice_rows))
        assert not re.search("EvalPython|MapInPandas|CartesianProduct|NestedLoop", text)


def steps(pages, use_api=False):
    """The unsettled steps of layer 2 over stored pages: captures, homepages, sub-pages."""
    paths = candidate_paths(CFG)
    latest_of = captures(pages, paths, use_api)
    homes = reduce_homepages(chosen_pages(pages, latest_of, (0, 1), (), use_api), CFG, True)
    subs = reduce_subpages(chosen_pages(pages, latest_of, subpage_numbers(paths), paths, use_api))
    return latest_of, homes, subs


def test_html_is_never_shuffled(spark, tmp_path):
    _, _, pages = stored(spark, tmp_path)
    latest_of, homes, subs = steps(pages)
    assert "html" not in plan(latest_of).split("ReadSchema: ")[1]
    for reduced in (homes, subs):
        text = plan(reduced)
        # only the bitmap, made of addresses and times, is exchanged
        for line in text.splitlines():
            if re.search(r"Exchange|Aggregate|Sort", line):
                assert "html" not in line, line
        wide = [x for x in text.split("ReadSchema: ")[1:] if "html" in x.split(">")[0]]
        assert len(wide) == 1


def test_pages_are_filtered_before_any_pattern(spark, tmp_path):
    _, _, pages = stored(spark, tmp_path)
    _, homes, subs = steps(pages)
    for reduced in (homes, subs):
        text = reduced._jdf.queryExecution().optimizedPlan().toString()
        assert text.rindex("<script[^>]*>") < text.index("LeftSemi")
        assert text.count("<script[^>]*>") == 1
    assert homes._jdf.queryExecution().optimizedPlan().toString().count("(?iu)<title") == 1
    assert "<title" not in plan(subs)


def test_the_pages_are_not_in_the_last_plan(spark, tmp_path):
    leads, log, pages = stored(spark, tmp_path, 3)
    for slice_rows in (2, 1000):
        text = plan(qualify(leads, log, pages, CFG, slice_rows=slice_rows))
        assert "html" not in text and "<script" not in text


def test_no_wide_rows_are_sorted_to_find_the_latest(spark, tmp_path):
    leads, log, pages = stored(spark, tmp_path)
    frames = [*steps(pages), page_facts(pages, CFG), homepage_source(pages, True)]
    for frame in frames:
        assert "SortAggregate" not in plan(frame)
    assert "SortAggregate" not in plan(qualify(leads, log, pages, CFG))


def test_filters_reach_the_scan_and_columns_are_pruned(spark, tmp_path):
    leads, log, pages = stored(spark, tmp_path)
    for step in steps(pages):
        assert "EqualTo(fetch_via,direct)" in plan(step)
    text = plan(qualify(leads, log, stages="layer1").select("domain_status"))
    assert "company_name" not in text.split("ReadSchema: ")[1].split("\n")[0]
    assert "website" in text


def test_counts_compute_no_names_and_no_bundles(spark, tmp_path):
    _, _, pages = stored(spark, tmp_path)
    chosen = chosen_pages(pages, captures(pages, (), False), (0,), (), False)
    text = reduce_homepages(chosen, CFG, False)._jdf.queryExecution().optimizedPlan().toString()
    assert "<script[^>]*>" in text
    assert "<title" not in text and "HOMEPAGE" not in text

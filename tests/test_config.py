import json

import pytest

from leadsieve.config import SieveConfig, candidate_paths, keyword_table, load_config
from leadsieve.config import require_keywords


def test_missing_file_means_defaults(tmp_path):
    assert load_config() == load_config(str(tmp_path / "none.yaml")) == SieveConfig()
    assert SieveConfig().scrape_max_subpages == 3 and SieveConfig().negative_override


def test_sections_are_merged_over_defaults(tmp_path):
    data = {
        "industry_keywords": {"primary": ["a"], "negative": None},
        "keyword_match_rules": {"secondary_threshold": 5},
        "scrape_max_subpages": 1,
        "concurrency": {"layer1_workers": 3},
        "own": 1,
    }
    path = tmp_path / "c.json"
    path.write_text(json.dumps(data))
    cfg = load_config(str(path))
    assert (cfg.primary, cfg.secondary, cfg.negative) == (("a",), (), ())
    assert (cfg.primary_threshold, cfg.secondary_threshold) == (1, 5)
    assert cfg.request_timeout == 10 and cfg.scrape_max_subpages == 1
    assert cfg.other["own"] == 1
    with pytest.raises(AttributeError):
        cfg.primary = ()


def test_yaml(tmp_path):
    pytest.importorskip("yaml")
    path = tmp_path / "c.yaml"
    path.write_text("industry_keywords:\n  primary: [a, b]\nconcurrency: {request_timeout: 4}\n")
    cfg = load_config(str(path))
    assert cfg.primary == ("a", "b") and cfg.request_timeout == 4
    path.write_text("")
    assert load_config(str(path)) == SieveConfig()


def test_bad_settings():
    for bad in ({"primary": "word"}, {"primary": [1]}):
        with pytest.raises(ValueError):
            SieveConfig.from_mapping({"industry_keywords": bad})
    with pytest.raises(ValueError):
        SieveConfig.from_mapping({"scrape_max_subpages": -1})
    with pytest.raises(ValueError):
        require_keywords(SieveConfig().with_keywords(negative=["x"]))
    require_keywords(SieveConfig().with_keywords(secondary=["x"]))


def test_candidate_paths():
    assert candidate_paths(SieveConfig()) == ("/services", "/about", "/about-us")
    cfg = SieveConfig.from_mapping({"scrape_paths": ["/About/", "x"], "scrape_max_subpages": 9})
    assert candidate_paths(cfg, ("/X", "x//")) == (
        "/About/", "x", "/X", "/services", "/about-us", "/what-we-do",
    )
    assert candidate_paths(SieveConfig(scrape_max_subpages=0)) == ()


def test_keyword_table(spark):
    cfg = SieveConfig().with_keywords(["a", "b"], [], ["c"])
    rows = [tuple(r) for r in keyword_table(spark, cfg).orderBy("kind", "ord").collect()]
    assert rows == [("negative", 0, "c"), ("primary", 0, "a"), ("primary", 1, "b")]

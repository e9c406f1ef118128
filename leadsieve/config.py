"""Immutable run configuration (driver side only, a few hundred bytes)."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from typing import Any

# Thresholds, time-out and page limit used when nothing is configured.
PRIMARY_THRESHOLD = 1
SECONDARY_THRESHOLD = 2
NEGATIVE_OVERRIDE = True
REQUEST_TIMEOUT = 10
SCRAPE_MAX_SUBPAGES = 3

# Sub-pages looked up when nothing else is configured.
DEFAULT_SCRAPE_PATHS = (
    "/services",
    "/services/",
    "/about",
    "/about-us",
    "/what-we-do",
)


def _terms(value: Any, where: str) -> tuple[str, ...]:
    """A keyword or path list; a missing or null list means an empty one."""
    if value is None:
        return ()
    if isinstance(value, str) or not all(isinstance(v, str) for v in value):
        raise ValueError(f"{where} must be a list of strings")
    return tuple(value)


@dataclass(frozen=True)
class SieveConfig:
    primary: tuple[str, ...] = ()
    secondary: tuple[str, ...] = ()
    negative: tuple[str, ...] = ()
    primary_threshold: int = PRIMARY_THRESHOLD
    secondary_threshold: int = SECONDARY_THRESHOLD
    negative_override: bool = NEGATIVE_OVERRIDE
    request_timeout: int = REQUEST_TIMEOUT
    scrape_paths: tuple[str, ...] = ()
    scrape_max_subpages: int = SCRAPE_MAX_SUBPAGES
    other: Mapping[str, Any] = field(default_factory=dict, compare=False)

    @classmethod
    def from_mapping(cls, data: Mapping[str, Any] | None) -> "SieveConfig":
        """Lay a nested mapping over the defaults, one section at a time.

        A setting that is absent keeps its default; settings that steer network
        access only are kept in ``other`` and have no effect on the results.
        """
        data = dict(data or {})
        words = data.pop("industry_keywords", None) or {}
        rules = data.pop("keyword_match_rules", None) or {}
        limits = data.pop("concurrency", None) or {}
        cfg = cls(
            primary=_terms(words.get("primary"), "industry_keywords.primary"),
            secondary=_terms(words.get("secondary"), "industry_keywords.secondary"),
            negative=_terms(words.get("negative"), "industry_keywords.negative"),
            primary_threshold=rules.get("primary_threshold", PRIMARY_THRESHOLD),
            secondary_threshold=rules.get("secondary_threshold", SECONDARY_THRESHOLD),
            negative_override=bool(rules.get("negative_override", NEGATIVE_OVERRIDE)),
            request_timeout=limits.get("request_timeout", REQUEST_TIMEOUT),
            scrape_paths=_terms(data.pop("scrape_paths", None), "scrape_paths"),
            scrape_max_subpages=data.pop("scrape_max_subpages", SCRAPE_MAX_SUBPAGES),
            other={**data, "concurrency": dict(limits)},
        )
        if cfg.scrape_max_subpages < 0:
            raise ValueError("scrape_max_subpages must not be negative")
        return cfg

    def with_keywords(self, primary=(), secondary=(), negative=()) -> "SieveConfig":
        return replace(
            self, primary=tuple(primary), secondary=tuple(secondary), negative=tuple(negative)
        )

    def keyword_rows(self) -> list[tuple[str, int, str]]:
        """``(kind, ord, keyword)`` rows of the configured lists."""
        lists = {"primary": self.primary, "secondary": self.secondary, "negative": self.negative}
        return [(kind, i, k) for kind, terms in lists.items() for i, k in enumerate(terms)]


def keyword_table(spark, cfg: SieveConfig):
    """The keyword lists as a small DataFrame ``(kind, ord, keyword)``."""
    return spark.createDataFrame(
        cfg.keyword_rows(), "kind string, ord int, keyword string"
    )


def load_config(path: str | None = None) -> SieveConfig:
    """Read a JSON or YAML file over the defaults; no file means the defaults.

    YAML needs PyYAML on the driver; JSON needs nothing.
    """
    if not path or not os.path.exists(path):
        return SieveConfig()
    with open(path, encoding="utf-8") as handle:
        content = handle.read()
    if path.endswith(".json"):
        return SieveConfig.from_mapping(json.loads(content or "{}"))
    try:
        import yaml
    except ImportError as exc:
        raise RuntimeError("reading a YAML config needs PyYAML; use a .json file") from exc
    return SieveConfig.from_mapping(yaml.safe_load(content))


def require_keywords(cfg: SieveConfig) -> None:
    """Refuse to run layer 2 with neither primary nor secondary keywords."""
    if not cfg.primary and not cfg.secondary:
        raise ValueError("no industry keywords configured: give primary or secondary keywords")


def candidate_paths(cfg: SieveConfig, extra: tuple[str, ...] = ()) -> tuple[str, ...]:
    """Sub-pages to look up: configured, then extra, then default paths.

    Paths that differ only in case or trailing slashes count once (first
    spelling wins); the list is cut to the configured number.
    """
    first = {}
    for path in (*cfg.scrape_paths, *extra, *DEFAULT_SCRAPE_PATHS):
        first.setdefault(path.rstrip("/").lower(), path)
    return tuple(first.values())[: cfg.scrape_max_subpages]

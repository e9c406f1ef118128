"""URL filtering with a bit-parallel automaton of all wildcard rules.

Rules are packed one after another into 64-bit words, one bit per state. A character of
the URL moves all rules at once: ``D = (D << 1 & MATCH[c]) | (D & STAY[c])``, where the shift carries
from word to word. A task steps all URLs of a batch together, the longest last, so a step
is a few array operations whatever the number of URLs.

The canonical URL is host and path. ``*`` stands for any run without ``/``, ``**`` for any
run, ``?`` for one character but ``/``. Host rules win over the other globs, the longest first,
then the one listed first. Without a fitting rule a URL is blocked if a block glob fits or
it has no host, else allowed.

Defined results: a null URL and one without ``://`` have an empty host and path; repeated rows
are judged one by one; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadsieve.llm.tables import raw_texts


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)

#: Hosts that are blocked unless a rule allows them.
BLOCK_GLOBS = ("*casino*", "*poker*", "*-bets.*", "*porn*", "*xxx*")

ANY, NO_SLASH, ONE = object(), object(), object()


def tokens_of(glob: str) -> list:
    """The glob as bytes and wildcard marks."""
    out: list = []
    for i, part in enumerate(glob.split("**")):
        out += [ANY] * (i > 0)
        for c in part:
            out += {"*": [NO_SLASH], "?": [ONE]}.get(c) or list(c.encode())
    return out


class Automaton:
    """All patterns, simulated together; ``matches`` has a row per URL and a column per pattern."""

    def __init__(self, patterns: list[list]):
        states = [1 + sum(t is not ANY and t is not NO_SLASH for t in p) for p in patterns]
        starts = np.concatenate(([0], np.cumsum(states)))
        self.words = max(1, -(-int(starts[-1]) // 64))
        self.match = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        self.begin = np.zeros(self.words, np.uint64)
        self.accept = [divmod(int(s) - 1, 64) for s in starts[1:]]
        for p, at in zip(patterns, starts[:-1].tolist(), strict=True):
            self._set(self.begin, at)
            for t in p:
                if t is ANY or t is NO_SLASH:
                    for c in range(256):
                        if t is ANY or c != 0x2F:
                            self._set(self.stay[c], at)
                    continue
                at += 1
                for c in range(256):
                    if c == t or (t is ONE and c != 0x2F):
                        self._set(self.match[c], at)

    @staticmethod
    def _set(words: np.ndarray, bit: int) -> None:
        words[bit // 64] |= np.uint64(1 << bit % 64)

    def matches(self, urls: list[bytes]) -> np.ndarray:
        sizes = np.fromiter(map(len, urls), np.int64, len(urls))
        order = np.argsort(-sizes, kind="stable")
        text = np.frombuffer(b"".join(urls), np.uint8)
        at = (np.cumsum(sizes) - sizes)[order]
        ends = np.searchsorted(-sizes[order], -np.arange(1, int(sizes.max(initial=0)) + 1), "right")
        now = np.tile(self.begin, (len(urls), 1))
        for step, active in enumerate(ends.tolist()):
            c = text[at[:active] + step]
            d = now[:active]
            moved = d << np.uint64(1)
            moved[:, 1:] |= d[:, :-1] >> np.uint64(63)
            now[:active] = moved & self.match[c] | d & self.stay[c]
        out = np.empty((len(urls), len(self.accept)), bool)
        for k, (word, bit) in enumerate(self.accept):
            out[order, k] = now[:, word] >> np.uint64(bit) & np.uint64(1)
        return out


def split_url(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z only) and path; empty without ``://``."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), upper, lower)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def judged(
    pages: DataFrame, rules: tuple[Rule, ...] = RULES, block_globs: tuple[str, ...] = BLOCK_GLOBS
) -> DataFrame:
    """Per page ``page_id, host, path, rule, verdict``."""
    best_first = sorted(rules, key=lambda r: -len(r.host + r.path))
    literal = [list((r.host + r.path).encode()) for r in best_first]
    patterns = [p + [ANY] for p in literal]
    patterns += [[NO_SLASH, ord(".")] + p + [ANY] for p in literal]
    for g in map(tokens_of, block_globs):
        patterns += [g, [*g, ord("/"), ANY]]
    automaton, n = Automaton(patterns), len(rules)
    names = np.array([r.host + r.path for r in best_first] + [None], object)
    verdicts = np.array([r.verdict for r in best_first] + [None], object)
    kind = dict(pages.dtypes)["page_id"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts = raw_texts(batch.column("host"))
            hit = automaton.matches([h + p for h, p in zip(hosts, raw_texts(batch.column("path")), strict=True)])
            fits = np.column_stack((hit[:, :n] | hit[:, n : 2 * n], np.ones(len(hit), bool)))
            which = fits.argmax(axis=1)
            empty = np.fromiter((not h for h in hosts), bool, len(hosts))
            own = np.where(empty | hit[:, 2 * n :].any(axis=1), "block", "allow")
            verdict = np.where(which < n, verdicts[which], own)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names[which], pa.string()), pa.array(verdict, pa.string())],
                names=["page_id", "host", "path", "rule", "verdict"],
            )

    host, path = split_url(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    return parts.mapInArrow(judge, f"page_id {kind}, host string, path string, rule string, verdict string")

import sys
import time

from leadsieve.functions.text import (
    WS,
    WS_CHARS,
    html_to_text,
    nz,
    snippet,
    strip,
)
from pyspark.sql import functions as F

ALL_SPACES = [chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace()]


def test_white_space_is_unicode_white_space(evaluate):
    assert sorted(WS_CHARS) == sorted(ALL_SPACES)
    around = [f"{c}a{c}b{c}{c}" for c in ALL_SPACES]
    assert evaluate(strip, around) == [f"a{c}b" for c in ALL_SPACES]
    assert evaluate(lambda v: F.regexp_replace(v, f"{WS}+", "_"), ALL_SPACES) == ["_"] * len(
        ALL_SPACES
    )
    assert evaluate(lambda v: v.rlike(WS), ["​", "﻿", "a", "᠎"]) == [False] * 4


def test_html_to_text(evaluate):
    cases = {
        None: None,
        "": None,
        "<script></script>": "",
        "a<SCRIPT type=x>\nvar a = 1 < 2;\n</SCRIPT>b": "a b",
        "a<ſcript>x</ſcript>b": "a b",
        "<style>p{}</style><p>x</p>": "x",
        "a<script>never closed": "a never closed",
        "1 <> 2 < 3": "1 <> 2 < 3",
        "&amp;lt;b&amp;gt; &nbsp;&#39;q&quot;": "<b> 'q\"",
        " a\u001c　b \n c\u0085": "a b c",
        "a  b\t\tc d": "a b c d",
        "&copy; stays": "&copy; stays",
    }
    assert evaluate(html_to_text, list(cases)) == list(cases.values())


def test_whole_pages_are_read(evaluate):
    late = "x" * 70_000 + "<script>tail</script>y<b>z</b>"
    assert evaluate(html_to_text, [late, "é" * 20_000]) == ["x" * 70_000 + " y z", "é" * 20_000]


def test_unclosed_markup_takes_linear_time(evaluate):
    size = 1_000_000
    pages = ["<script>" * (size // 8), "<style>a " * (size // 9), "<" * size, "<b>x</b>" + "<p " * (size // 3)]
    began = time.perf_counter()
    got = evaluate(html_to_text, pages)
    assert time.perf_counter() - began < 30
    assert got == ["", " ".join("a" * (size // 9)), "<" * size, "x " + ("<p " * (size // 3)).strip()]


def test_snippet_and_missing(evaluate):
    assert evaluate(snippet, [None, "", "ab", "é" * 400]) == ["", "", "ab", "é" * 300]
    assert evaluate(nz, [None, "", " "]) == [None, None, " "]

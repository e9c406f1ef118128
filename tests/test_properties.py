"""Properties over generated input, checked in one job per property."""

from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leadsieve.functions.domains import with_normalized_url
from leadsieve.functions.names import with_clean_name, with_site_name
from leadsieve.functions.text import html_to_text, strip

PIECES = st.sampled_from(
    ["<", ">", "<p>", "</p>", "<script>", "</SCRIPT>", "<style x>", "</style>", "&amp;", "lt;", " ",
     "\n", "\t", "\xa0", "\x1c", "a", "É", "ß", "www.", "http://", "//", ".com", "/", "?", "LLC", ", ",
     "Co", ".", "-", "|", "<title>", "</title>", '"name": "', '"', "x.com", "hvac", "of"]
)
TEXTS = st.lists(st.lists(PIECES, max_size=25).map("".join), min_size=60, max_size=60)
RUNS = settings(
    max_examples=4,
    deadline=None,
    suppress_health_check=list(HealthCheck),
    derandomize=True,
    phases=[Phase.generate],  # shrinking would run a Spark job per step
)


@given(TEXTS)
@RUNS
def test_page_text(evaluate, texts):
    for html, text in zip(texts, evaluate(html_to_text, texts)):
        assert (text is None) == (html == "")
        if text is not None:
            assert text == text.strip()
            assert text == " ".join(text.split())


@given(TEXTS)
@RUNS
def test_strip_is_python_strip(evaluate, texts):
    assert evaluate(strip, texts) == [t.strip() for t in texts]


@given(TEXTS)
@RUNS
def test_urls_are_bare_and_lower_case(spark, texts):
    # The path is cut at most to the end of its line, so line breaks are left out here.
    frame = spark.createDataFrame([(t.replace("\n", ""),) for t in texts], "t string")
    for row in with_normalized_url(frame, F.col("t"), "u").collect():
        if row.u is not None:
            assert row.u.startswith("https://") and row.u == row.u.lower()
            assert not set(row.u[8:]) & set("/?#")


@given(TEXTS)
@RUNS
def test_names(spark, texts):
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in with_clean_name(frame, F.col("t"), "n").collect():
        assert row.n == row.n.strip() and row.n[-1:] not in tuple(",.-|")
    for row in with_site_name(frame, "t", "n", "s").collect():
        assert (row.n is None) == (row.s in ("no_html", "fallback"))
        assert row.s in ("og:site_name", "title_tag", "og:title", "schema_org", "fallback", "no_html")

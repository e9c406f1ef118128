from leadsieve.functions.names import with_clean_name, with_site_name
from pyspark.sql import functions as F

CLEAN = {
    "ABC, Inc.": "Abc",
    "Foo L.L.P.": "Foo L",
    "PC Repair Pros": "Repair Pros",
    "Co-op Foods": "-op Foods",
    "HVAC PROS": "Hvac Pros",
    "us of a": "Us of A",
    "ABC CORP OF THE WEST": "Abc of the West",
    "best hvac in usa": "Best HVAC in USA",
    "LLC": "",
    "": "",
    None: None,
    "Mixed Case Limited": "Mixed Case",
    "Costco": "Costco",
    "iñco Foods": "iñco Foods",
    "A&amp;B &#x27;n&apos; Co": "A&B 'n'",
    "Name - | . ,": "Name",
    "ßa b": "Ssa B",
    "ǆ b": "ǅ B",
    "123 45": "123 45",
    "Inc.Xy": "Xy",
    "Foo,   LLC Bar": "Foo Bar",
}


def test_clean_name(spark):
    frame = spark.createDataFrame(list(CLEAN.items()), "typed string, want string")
    rows = with_clean_name(frame, F.col("typed"), "got").collect()
    assert {r.typed: r.got for r in rows} == CLEAN


SITE = '<meta property="og:site_name" content="{}">'
OG = '<meta content="{}" property="og:title">'
PAGES = {
    None: (None, "no_html"),
    "": (None, "no_html"),
    "<p>nothing": (None, "fallback"),
    SITE.format("Bob's Septic"): ("Bob", "og:site_name"),
    "<META name=x CONTENT='River Co' data-a PROPERTY='OG:SITE_NAME'>": ("River", "og:site_name"),
    SITE.format(" ") + "<title>Acme</title>": ("Acme", "title_tag"),
    SITE.format("x" * 100) + "<title>Acme</title>": ("Acme", "title_tag"),
    SITE.format("x" * 99): ("X" + "x" * 98, "og:site_name"),
    "<title>Home - Coca-Cola | Site</title>": ("Coca", "title_tag"),
    "<title>a | Official  Site | Official Site | ok go</title>": ("Official  Site", "title_tag"),
    "<title></title><title lang=en>Second One</title>": ("Second One", "title_tag"),
    f"<title>{'y' * 60}: Short</title>": ("Short", "title_tag"),
    "<title>Home</title>" + OG.format("Home | Real"): ("Home", "og:title"),
    "<title>Home</title>" + OG.format("z" * 60 + " | Real"): (None, "fallback"),
    '<title>Home</title>{"name" : "River Valley"}': ("River Valley", "schema_org"),
    '<title>Home</title>{"name":"Single"} {"name":"Two Words"}': (None, "fallback"),
    '<title>Home</title>{"Name":"Two Words"}': (None, "fallback"),
    '{"name":"a b c d e f g h"}': ("A B C D E F G H", "schema_org"),
    '{"name":"a b c d e f g h i"}': (None, "fallback"),
}


def test_site_name(spark):
    frame = spark.createDataFrame([(k,) for k in PAGES], "html string")
    rows = with_site_name(frame, "html", "name", "source").collect()
    assert {r.html: (r["name"], r.source) for r in rows} == PAGES

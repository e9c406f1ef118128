"""White space, missing values, HTML to text, snippets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Unicode text processing sees it. Java's ``\s`` is ASCII only and even
# its Unicode mode misses U+001C..U+001F, so every pattern here uses this class.
WS = r"[\s\x1c-\x1f\x85\p{Z}]"

# The same class spelled out, for trimming without a regular expression.
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202f\u205f\u3000"
)

# Lengths of the text samples that are written out, in characters.
SNIPPET = 300
SHORT_SNIPPET = 200

# Entities decoded in page text, in this order.
TEXT_ENTITIES = (
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&nbsp;", " "),
    ("&#39;", "'"),
    ("&quot;", '"'),
)

# Markup removed from a page, each replaced by one space, in this order.
SCRIPT_BLOCK = r"(?isu)<script[^>]*>.*?</script>"
STYLE_BLOCK = r"(?isu)<style[^>]*>.*?</style>"
ANY_TAG = r"<[^>]+>"


def nz(c: Column) -> Column:
    """Null for an empty string: both mean 'missing'."""
    return F.nullif(c, F.lit(""))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def left(c: Column, n: int) -> Column:
    return F.left(c, F.lit(n))


def decode(c: Column, entities) -> Column:
    for entity, char in entities:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def up_to_last(c: Column, closing: str) -> Column:
    """Text up to the last place where the pattern ``closing`` ends; empty without one."""
    return F.regexp_extract(c, rf"(?isu)\A.*{closing}", 0)


def bound(c: Column, use) -> Column:
    """``use(c)`` with ``c`` computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def replace_closed(c: Column, pattern: str, closing: str) -> Column:
    """Put blanks for ``pattern``, which ends in ``closing``.

    Behind the last ``closing`` nothing can match, but every opening would be followed to the
    end of the text to find that out; that part is left alone.
    """

    def parts(text: Column) -> Column:
        return bound(
            up_to_last(text, closing),
            lambda head: F.concat(
                F.regexp_replace(head, pattern, " "), F.substr(text, F.length(head) + 1)
            ),
        )

    return bound(c, parts)


def html_to_text(html: Column) -> Column:
    """Readable text of a whole page; null when there is no page at all."""
    text = replace_closed(html, SCRIPT_BLOCK, "</script>")
    text = replace_closed(text, STYLE_BLOCK, "</style>")
    text = replace_closed(text, ANY_TAG, ">")
    text = decode(text, TEXT_ENTITIES)
    # Single blanks stay as they are; only longer or unusual runs are rewritten.
    text = F.regexp_replace(text, rf"[{WS}&&[^ ]]{WS}*| {WS}+", " ")
    return F.when(html != "", F.btrim(text))


def snippet(text: Column, n: int = SNIPPET) -> Column:
    return F.coalesce(left(text, n), F.lit(""))

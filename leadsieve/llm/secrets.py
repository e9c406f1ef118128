"""Secret scan with linking of multipart credentials, in DataFrame functions only.

Strong patterns (secrets by name, access ids, long hexadecimal runs) are reported wherever they
occur. Weak candidates mean nothing alone: an account name, an opaque mixed run, an address of a
service. They are reported only when what completes them lies in their scope, the text
within ``REACH`` code points of them but not in them: a name needs a secret, an opaque run needs an
identifier, an address needs both. No part completes itself by what it contains or overlaps.

The interval join runs as a sweep: beginnings and ends of a document's parts are sorted by place, and
running maxima and minima of each role say how near the next part before and after is. That is one
shuffle of the parts, no pairs, and linear in their number. Texts are not shuffled. A cheap look for what a
kind can't do without spares most texts its patterns.

Places count code points, ends are exclusive. Defined results: null and empty texts have no
parts; parts of one kind do not overlap, of several kinds they may; an opaque run that one
strong part covers wholly is not reported again; rows are scanned one by one even if they repeat a ``doc_id``; an empty
table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Code points between a weak candidate and what completes it.
REACH = 256


class Kind(NamedTuple):
    """``least``: shortest value of ``group``; ``needs``: classes a match must hold; ``strong``: reported alone.

    ``guard``: a pattern that every text with a match has.
    """

    name: str
    pattern: str
    group: int
    least: int
    role: str
    strong: bool
    guard: str
    needs: tuple[str, ...] = ()


KINDS = (
    Kind(
        "assign",
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        8,
        "secret",
        True,
        "[:=]",
    ),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 16, "identifier", True, "AKIA"),
    Kind("hex", r"[0-9a-f]+", 0, 32, "secret", True, "[0-9a-f]{32}"),
    Kind(
        "account",
        r"""(?i)(user(?:name)?|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]+)""",
        2,
        3,
        "identifier",
        False,
        "[:=]",
    ),
    Kind("opaque", r"[A-Za-z0-9+/]+", 0, 20, "secret", False, "[A-Za-z0-9+/]{20}", ("[0-9]", "[A-Z]", "[a-z]")),
    Kind("endpoint", r"""[a-z][a-z0-9+.-]*://[^\x00-\x20"'<>]+""", 0, 8, "endpoint", False, "://"),
)


def parts(text: Column, kind: Kind, number: int) -> Column:
    """An array of the kind's matches in order, each with the length of the text before it since the last one."""
    pattern = kind.pattern
    if pattern.endswith("+") and not kind.group and kind.name in ("hex", "opaque"):
        pattern = f"{pattern[:-1]}{{{kind.least},}}"  # the same runs: shorter ones are dropped anyway
    gaps = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = whole if not kind.group else F.regexp_extract_all(text, F.lit(pattern), F.lit(kind.group))
    zipped = F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), value.alias("value"))

    def part(x: Column, i: Column) -> Column:
        good = F.length(x["value"]) >= kind.least
        for needed in kind.needs:
            good = good & F.regexp_like(x["value"], F.lit(needed))
        return F.struct(
            F.lit(number).alias("kind"),
            i.alias("turn"),
            x["gap"].alias("gap"),
            F.length(x["whole"]).alias("size"),
            good.alias("good"),
        )

    found = F.filter(F.transform(zipped, part), lambda p: p["size"].isNotNull())
    if not re.search(r"[\[{]", kind.guard):
        guard = F.contains(text, F.lit(kind.guard))
    else:
        guard = F.regexp_like(text, F.lit(kind.guard))
    return F.when(guard, found).otherwise(F.array().cast("array<struct<kind:int,turn:int,gap:int,size:int,good:boolean>>"))


def found_parts(documents: DataFrame) -> DataFrame:
    """``doc_id, row, kind, start, end`` of every good match; one row with nulls for a document without."""
    text = F.coalesce("text", F.lit("")).alias("text")
    numbered = documents.select("doc_id", text, F.monotonically_increasing_id().alias("row"))
    found = F.concat(*[parts(F.col("text"), k, i) for i, k in enumerate(KINDS)])
    rows = numbered.select("doc_id", "row", F.explode_outer(found).alias("p"))
    # what fails still moves the places of those after it, so it is dropped only then
    so_far = Window.partitionBy("doc_id", "row", "p.kind").orderBy("p.turn")
    by_doc = rows.repartition("doc_id", "row")
    end = F.sum(F.col("p.gap") + F.col("p.size")).over(so_far)
    placed = by_doc.select("doc_id", "row", "p.kind", "p.good", "p.size", end.alias("end"))
    good = F.coalesce(F.col("good"), F.lit(False))
    return placed.select(
        "doc_id",
        "row",
        F.when(good, F.col("kind")).alias("kind"),
        F.when(good, F.col("end") - F.col("size")).alias("start"),
        F.when(good, F.col("end")).alias("end"),
    )


def linked(found: DataFrame, reach: int = REACH) -> DataFrame:
    """The parts with ``reported``: strong ones, and weak ones whose scope completes them.

    What completes a part lies beside it, not in it: every part is an event at its beginning and one at its end,
    and a sweep over the events knows the last end up to a beginning and the first beginning from an end on.
    """
    at_start = F.col("event") == 1
    events = found.select(
        "*", F.explode(F.expr("CASE WHEN kind IS NULL THEN array(1) ELSE array(0, 1) END")).alias("event")
    ).withColumn("at", F.when(at_start, F.col("start")).otherwise(F.col("end")))
    one = Window.partitionBy("doc_id", "row")
    ahead = one.orderBy("at", "event", "kind", "end").rowsBetween(Window.unboundedPreceding, -1)
    behind = one.orderBy(F.desc("at"), F.desc("event"), F.desc("kind"), F.desc("end")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    kind = F.col("kind")

    def of(numbers: list[int]) -> Column:
        return kind.isin(numbers)

    roles = {r: [i for i, k in enumerate(KINDS) if k.role == r] for r in ("identifier", "secret")}
    strong = [i for i, k in enumerate(KINDS) if k.strong]
    marks = {r: of(n) for r, n in roles.items()}
    before = {f"{r}_before": F.max(F.when(m & ~at_start, F.col("end"))).over(ahead) for r, m in marks.items()}
    after = {f"{r}_after": F.min(F.when(m & at_start, F.col("start"))).over(behind) for r, m in marks.items()}
    covering = F.max(F.when(of(strong) & at_start, F.col("end"))).over(ahead)
    swept = events.withColumns({**before, "strong_end": covering}).withColumns(after)
    # what lies before a part is known at its beginning, what lies behind it at its end
    rows = swept.groupBy("doc_id", "row", "kind", "start", "end").agg(
        *[F.max(F.when(at_start, F.col(c))).alias(c) for c in (*before, "strong_end")],
        *[F.max(F.when(~at_start, F.col(c))).alias(c) for c in after],
    )

    def near(role: str) -> Column:
        near_before = F.col("start") - F.col(f"{role}_before") <= reach
        near_after = F.col(f"{role}_after") - F.col("end") <= reach
        return F.coalesce(near_before, F.lit(False)) | F.coalesce(near_after, F.lit(False))

    # strong kinds come first of those with one start, so none that covers a run stands behind it
    inside = F.coalesce(F.col("strong_end") >= F.col("end"), F.lit(False))
    weak = {
        "account": near("secret"),
        "opaque": near("identifier") & ~inside,
        "endpoint": near("identifier") & near("secret"),
    }
    rule = F.when(of(strong), True)
    for i, k in enumerate(KINDS):
        if not k.strong:
            rule = rule.when(kind == i, weak[k.name])
    return rows.select("doc_id", "row", "kind", "start", "end", F.coalesce(rule, F.lit(False)).alias("reported"))


def secrets(documents: DataFrame, reach: int = REACH) -> DataFrame:
    """Per document ``doc_id, found``: its reported parts ``start, kind, end``, in order of place and kind."""
    rows = linked(found_parts(documents), reach)
    part = F.when(F.col("reported"), F.struct("start", "kind", "end"))
    found = F.array_sort(F.collect_list(part)).alias("found")
    return rows.groupBy("doc_id", "row").agg(found).select("doc_id", "found")


def spans_of(found: str, strong_only: bool) -> Column:
    """``kind:start:end`` of the parts, comma-joined."""
    names = F.array(*[F.lit(k.name) for k in KINDS])
    strong = sum(k.strong for k in KINDS)  # they come first
    kept = F.filter(found, lambda p: p["kind"] < strong) if strong_only else F.col(found)
    texts = F.transform(
        kept,
        lambda p: F.concat_ws(":", F.get(names, p["kind"]), p["start"].cast("string"), p["end"].cast("string")),
    )
    return F.array_join(texts, ",")


def count_of(found: str, name: str) -> Column:
    number = next(i for i, k in enumerate(KINDS) if k.name == name)
    return F.size(F.filter(found, lambda p: p["kind"] == number)).cast("long")

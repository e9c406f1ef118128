"""Records of large CSV files, whose fields may hold line breaks, read by all cores.

A line break ends a record only outside quotes, so a reader that starts in the middle of a file can't tell. Here
every line says what it does to either state: a line that is begun outside quotes ends inside
or outside, and so does one that is begun inside. Such effects can be chained without knowing where
they start, first over the lines of each split, then over the splits of each file, one row each;
that settles every line's state and numbers the records without gaps. No file is one task.

The states, from the way quotes are read: a quote opens a field only at its beginning, the next
single quote closes it, two quotes in a row are one character, and what follows a closing quote up to the
separator belongs to the field. Other quotes are plain characters.

Defined results: lines end with a line feed, a carriage return, or both, and a break inside a field becomes
a line feed; empty lines outside quotes are no records; a byte-order mark at the beginning of a
file is dropped; a quote that is never closed takes the rest of its file into one record, as it
does for any reader of the format (such a record is as long as that rest, and is held by one task).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadsieve.sources.storage import settled

BOM = "﻿"

# A quoted field from its opening to its closing quote, doubled quotes removed before.
_QUOTED = rf'(^{BOM}?|,)"[^"]*"'
_OPENED = rf'(?:^{BOM}?|,)"'


def _single(line: Column) -> Column:
    """The line without doubled quotes, which change no state."""
    return F.replace(line, F.lit('""'), F.lit(""))


def unquoted(line: Column) -> Column:
    """The line with ``x`` for every field that is quoted from its beginning to its end."""
    return F.regexp_replace(_single(line), _QUOTED, "$1x")


def opens(line: Column) -> Column:
    """Whether a line that is begun outside quotes ends inside."""
    return unquoted(line).rlike(_OPENED)


def goes_on(line: Column) -> Column:
    """Whether a line that is begun inside quotes ends inside."""
    single = _single(line)
    closing = F.instr(single, '"')
    # the closed field goes on up to its separator, so what follows begins no field
    rest = F.concat(F.lit("x"), F.substr(single, closing + 1))
    return (closing == 0) | opens(rest)


def field_count(record: Column) -> Column:
    bare = unquoted(record)
    return F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1


def chained(df: DataFrame, part: list[str], order: list[str], outside: str, inside: str) -> DataFrame:
    """Add ``from_outside`` and ``from_inside``: the state before each row, by the state before its part's first.

    ``outside`` and ``inside`` name the effects of a row: whether it ends inside if it begins outside
    or inside. An effect keeps the state, swaps it, or sets it; the state before a row is what the
    last row set, swapped as often as rows in between say.
    """
    out, in_ = F.col(outside), F.col(inside)
    so_far = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    swaps = F.coalesce(F.sum(F.when(out & ~in_, 1).otherwise(0)).over(so_far), F.lit(0))
    with_swaps = df.withColumn("_swaps", swaps)
    sets = F.when(out == in_, F.struct(out.alias("to"), F.col("_swaps").alias("at")))
    last = with_swaps.withColumn("_set", F.last(sets, ignorenulls=True).over(so_far))

    def swapped(state: Column, times: Column) -> Column:
        return F.when(times % 2 == 1, ~state).otherwise(state)

    own = swapped(F.col("_set")["to"], F.col("_swaps") - F.col("_set")["at"])
    return last.withColumns(
        {
            "from_outside": F.coalesce(own, swapped(F.lit(False), F.col("_swaps"))),
            "from_inside": F.coalesce(own, swapped(F.lit(True), F.col("_swaps"))),
        }
    ).drop("_swaps", "_set")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, at, value, opens, goes_on, blank``: the lines of every split in order."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        "value",
    )
    value = F.col("value")
    return lines.withColumns(
        {"opens": opens(value), "goes_on": goes_on(value), "blank": value.isin("", BOM)}
    )


def _splits(lines: DataFrame) -> DataFrame:
    """``file, block, inside, before``: each split's state at its beginning and the records before it in its file.

    One row a split: small, however large the files are.
    """

    def after(begun: str) -> Column:
        return F.when(F.col(begun), F.col("goes_on")).otherwise(F.col("opens"))

    effects = lines.groupBy("file", "block").agg(
        F.max_by(after("from_outside"), "at").alias("to_outside"),
        F.max_by(after("from_inside"), "at").alias("to_inside"),
        F.count_if(~F.col("from_outside") & ~F.col("blank")).alias("n_outside"),
        F.count_if(~F.col("from_inside") & ~F.col("blank")).alias("n_inside"),
    )
    splits = chained(effects, ["file"], ["block"], "to_outside", "to_inside")
    n = F.when(F.col("from_outside"), F.col("n_inside")).otherwise(F.col("n_outside"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return splits.select(
        "file",
        "block",
        F.col("from_outside").alias("inside"),
        n.alias("n"),
        F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias("before"),
    )


def records(spark: SparkSession, path: str) -> DataFrame:
    """``file, record, text, place``: the records of the CSV files at ``path``, numbered from 0 in each file.

    ``place`` numbers the records behind the first ones, the headers, over all files: 0 to n - 1 in order of file
    names and records, null for headers. The lines are settled once in the shared folder, so splits are
    the same in every step.
    """
    lines = settled(_lines(spark, path), "lines")
    stated = chained(lines, ["file", "block"], ["at"], "opens", "goes_on")
    splits = settled(_splits(stated), "splits")
    numbered = stated.join(splits, ["file", "block"])
    numbered = numbered.withColumn("begun", F.when(F.col("inside"), F.col("from_inside")).otherwise(F.col("from_outside")))
    starts = ~F.col("begun") & ~F.col("blank")
    up_to_here = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    numbered = numbered.withColumn(
        "record", F.col("before") + F.sum(F.when(starts, 1).otherwise(0)).over(up_to_here) - 1
    ).where(F.col("begun") | ~F.col("blank"))
    whole = numbered.where(starts & ~F.col("opens")).select("file", "record", F.col("value").alias("text"))
    pieces = numbered.where(F.col("begun") | F.col("opens")).groupBy("file", "record").agg(
        F.array_sort(F.collect_list(F.struct("block", "at", "value"))).alias("pieces")
    )
    joined = pieces.select("file", "record", F.array_join(F.col("pieces")["value"], "\n").alias("text"))
    every = whole.unionByName(joined)
    # one row a file
    sizes = splits.groupBy("file").agg(F.sum("n").alias("n"))
    offsets = sizes.select(
        "file",
        F.coalesce(
            F.sum(F.greatest(F.col("n") - 1, F.lit(0))).over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("offset"),
    )
    first = F.col("record") == 0
    return every.join(offsets, "file").select(
        "file",
        "record",
        F.when(first, F.ltrim(F.col("text"), F.lit(BOM))).otherwise(F.col("text")).alias("text"),
        F.when(~first, F.col("offset") + F.col("record") - 1).alias("place"),
    )

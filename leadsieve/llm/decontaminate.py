"""Benchmark decontamination as a prefix-filtered join of rare shingles.

An item is cut into windows of ``window`` words (an item with fewer words is one window). A
window is contained in a document only if all its shingles are, so one of them is enough
to find it: the rarest over all documents. Documents are joined with the windows on that
shingle; its place in the window and the window's length say where the window must lie
in the document, and its words are compared there one by one.

Fixed-size bitmaps keep shingles that occur in no benchmark window out of the shuffles;
the joins are exact, so a full bitmap costs time and no result. A passage that many
documents share is one row per occurrence on the document side of an equi-join.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z became lower case. Defined results: null and
empty texts have no words and no hits; items without words match nothing; equal windows
of several items name all of them; rows are judged one by one even if they repeat a
``doc_id``; empty tables give no rows or no hits; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadsieve.llm.hashing import NOT_ALNUM, Words, mixed
from leadsieve.llm.tables import Bits, checkpointed, lean, lowered, slices

WINDOW = 10
SHINGLE = 5


def benchmark_windows(benchmark: DataFrame, window: int, shingle: int) -> DataFrame:
    """``words, items, width, shingles``: distinct windows, whose items they are, and their shingles in order."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = Words(lowered(part.column("text")), NOT_ALNUM)
                hashes = {w: (texts.shingles(w) >> np.uint64(1)).astype(np.int64) for w in range(1, shingle + 1)}
                rows: list[list] = [[], [], [], []]
                items = part.column("item").to_pylist()
                for item, a, b in zip(items, texts.first[:-1].tolist(), texts.first[1:].tolist(), strict=True):
                    n = min(window, b - a)
                    if not n:
                        continue
                    width = min(shingle, n)
                    for at in range(a, b - n + 1):
                        rows[0].append([texts.data[s:e] for s, e in zip(texts.start[at : at + n], texts.end[at : at + n], strict=True)])
                        rows[1].append(item)
                        rows[2].append(width)
                        rows[3].append(hashes[width][at : at + n - width + 1])
                types = [pa.list_(pa.binary()), pa.string(), pa.int32(), pa.list_(pa.int64())]
                arrays = [pa.array(r, t) for r, t in zip(rows, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=["words", "item", "width", "shingles"])

    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    cuts = items.mapInArrow(lean(cut), "words array<binary>, item string, width int, shingles array<long>")
    return cuts.groupBy("words", "width", "shingles").agg(F.collect_set("item").alias("items"))


def shingle_counts(documents: DataFrame, wanted: Bits, widths: list[int]) -> DataFrame:
    """``shingle, n``: how often each wanted shingle occurs in all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = [h for _, _, h in _occurrences(Words(lowered(part.column("text")), NOT_ALNUM), wanted, widths)]
                values, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values.astype(np.int64)), pa.array(n)], names=["shingle", "n"])

    return documents.select("text").mapInArrow(lean(count), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))


def _occurrences(words: Words, wanted: Bits, widths: list[int]):
    """Per width: document, place among all words, and hash of every wanted shingle."""
    for width in widths:
        hashes = words.shingles(width) >> np.uint64(1)
        at = np.flatnonzero(wanted.has(hashes))
        doc = np.searchsorted(words.first, at, "right") - 1
        whole = at + width <= words.first[doc + 1]
        yield doc[whole], at[whole], hashes[at[whole]]


def prefixes(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """``words, items, shingle, place``: the windows with their rarest shingle and where it stands in them."""
    each = windows.select("words", "items", F.posexplode("shingles").alias("place", "shingle"))
    ranked = each.join(counts, "shingle", "left").select(
        "words", "items", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "place").alias("first")
    )
    rarest = ranked.groupBy("words").agg(F.first("items").alias("items"), F.min("first").alias("first"))
    return rarest.select("words", "items", "first.shingle", "first.place")


def candidates(documents: DataFrame, wanted: Bits, widths: list[int], window: int) -> DataFrame:
    """Places where a prefix shingle may stand, each with the words around it, and one row per document without."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(lowered(part.column("text")), NOT_ALNUM)
                n_words = np.diff(words.first)
                found = list(_occurrences(words, wanted, widths))
                doc, at, h = (np.concatenate([f[i] for f in found]) for i in range(3))
                low = np.maximum(at - window + 1, words.first[doc])
                high = np.minimum(at + window, words.first[doc + 1])
                near = [
                    [words.data[s:e] for s, e in zip(words.start[a:b], words.end[a:b], strict=True)]
                    for a, b in zip(low.tolist(), high.tolist(), strict=True)
                ]
                every = np.arange(part.num_rows)
                rows = part.column("row").to_numpy().astype(np.uint64)
                alone = -1 - (mixed(rows) >> np.uint64(1)).astype(np.int64)
                row = pa.array(np.concatenate((every, doc)))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(row),
                        part.column("row").take(row),
                        pa.array(np.concatenate((n_words, n_words[doc]))),
                        pa.array(np.concatenate((alone, h.astype(np.int64)))),
                        pa.array(np.concatenate((every * 0, low - words.first[doc]))),
                        pa.array(np.concatenate((every * 0, at - low))),
                        pa.array([None] * len(every) + near, pa.list_(pa.binary())),
                    ],
                    names=["doc_id", "row", "n_words", "shingle", "low", "before", "near"],
                )

    kind = dict(documents.dtypes)["doc_id"]
    rows = documents.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    schema = f"doc_id {kind}, row long, n_words long, shingle long, low long, before long, near array<binary>"
    return rows.mapInArrow(lean(scan), schema)


def decontaminated(
    documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE
) -> DataFrame:
    """Per document ``doc_id, n_words, n_hit, items, spans``.

    ``spans`` are the word ranges (end exclusive) of the windows found, in order.
    """
    windows = checkpointed(benchmark_windows(benchmark, window, shingle))
    widths = sorted(r[0] for r in windows.select("width").distinct().collect()) or [shingle]
    counts = shingle_counts(documents, Bits(windows.select(F.explode("shingles"))), widths)
    first = checkpointed(prefixes(windows, counts))
    found = candidates(documents, Bits(first.select("shingle")), widths, window).join(first, "shingle", "left")
    begin, size = F.col("before") - F.col("place"), F.size("words")
    fits = (begin >= 0) & (begin + size <= F.size("near"))
    same = fits & F.expr("slice(near, int(greatest(before - place, 0)) + 1, size(words)) = words")
    span = F.when(same, F.struct((F.col("low") + begin).alias("start"), (F.col("low") + begin + size).alias("end")))
    hits = found.select("doc_id", "row", "n_words", span.alias("span"), F.when(same, F.col("items")).alias("items"))
    per_doc = hits.groupBy("doc_id", "row").agg(
        F.first("n_words").alias("n_words"),
        F.array_sort(F.collect_set("span")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda seen, s: F.struct(
            (seen["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], seen["end"]))).alias("n"),
            F.greatest(seen["end"], s["end"]).alias("end"),
        ),
    )
    return per_doc.select("doc_id", "n_words", covered["n"].alias("n_hit"), "items", "spans")

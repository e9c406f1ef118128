"""Near-duplicate documents from bottom-k sketches of one hash function.

1. A document's set are the hashes of its distinct word shingles; equal sets form a class,
   which from here on is one item with the smallest ``doc_id``.
2. The ``SKETCH`` smallest hashes are its sketch. Inverted lists of retained values give the
   candidates. A value's rank is the length of its list, and a class joins the lists of its
   rarest values only: as many as it takes to share one with every class whose sketch overlaps
   enough. A passage that many documents share is a long list that few classes need.
3. Inside a list, sketches are compared with the union-sketch estimate. It is exact where the
   sketches hold the whole sets; elsewhere it passes all within six standard deviations.
4. What passes is joined to clusters, in which exact Jaccard on the full sets confirms links.
5. Linked classes get their smallest ``doc_id`` by a distributed union.

Six standard deviations leave a chance of about one in 10**8 that a linked pair shares no
rare value. Sets are compared by 63-bit hashes of shingles.

Defined results: a null or empty text has an empty set and is linked with nothing; a text with
fewer words than a shingle has one shingle; rows that repeat a ``doc_id`` share what
either is linked with if it is the smallest of both classes; a row without ``doc_id`` is linked with nothing and kept, with a null
component; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadsieve.llm.hashing import SPACES, Words
from leadsieve.llm.linking import dealt, edge_batch, exact_links, groups, meetings, spanning
from leadsieve.llm.tables import Bits, checkpointed, components, lean, lowered, slices

WIDTH, PERCENT = 5, 80

SKETCH = 64

#: Members of a list that meet in one task on average.
LIST_CHUNK = 4096

#: Hashes that one chunk of a group holds on average.
CHUNK = 1_000_000

_FULL = np.iinfo(np.int64).max


def set_name(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def shingle_sets(documents: DataFrame, width: int, wanted: Bits) -> DataFrame:
    """``id, set_id, set``: the full sets of the documents that ``wanted`` may hold."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("id").to_numpy().astype(np.uint64) & np.uint64(_FULL)
            for part in slices(batch.filter(pa.array(wanted.has(keys))), "text"):
                sets = Words(lowered(part.column("text")), SPACES).shingle_sets(width)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        pa.array([set_name(s) for s in sets], pa.binary()),
                        pa.array([s.astype(np.int64) for s in sets], pa.list_(pa.int64())),
                    ],
                    names=["id", "set_id", "set"],
                )

    rows = documents.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("id"), "text")
    return rows.mapInArrow(lean(cut), "id long, set_id binary, set array<long>")


def sketches(documents: DataFrame, width: int) -> DataFrame:
    """``doc_id, n_shingles, set_id, sketch`` of every document."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = Words(lowered(part.column("text")), SPACES).shingle_sets(width)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([set_name(s) for s in sets], pa.binary()),
                        pa.array([s[:SKETCH].astype(np.int64) for s in sets], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n_shingles", "set_id", "sketch"],
                )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lean(sketch), "doc_id long, n_shingles long, set_id binary, sketch array<long>")


def slack(percent: int) -> float:
    """Six standard deviations of a sketch's estimate at the threshold."""
    p = percent / 100
    return 6 * math.sqrt(p * (1 - p) / SKETCH)


def listed(classes: DataFrame, percent: int) -> DataFrame:
    """``value, chunks, id``: the lists of rarest values that classes join, of two members or more."""
    share = percent / 100 - slack(percent)
    size = F.size("sketch")
    values = classes.select("id", size.alias("size"), F.explode("sketch").alias("value"))
    lengths = values.groupBy("value").agg(F.count("*").alias("n")).where("n > 1")
    known = values.join(lengths, "value")
    ranked = known.groupBy("id").agg(
        F.first("size").alias("size"), F.array_sort(F.collect_list(F.struct("n", "value"))).alias("shared")
    )
    # values with a list of their own rank before all others
    take = F.expr(f"size - int(floor({share} * size)) + 1 - (size - size(shared))")
    chosen = ranked.withColumn("take", take).where("take > 0")
    rows = chosen.select("id", F.explode(F.slice("shared", F.lit(1), F.col("take"))["value"]).alias("value"))
    rows = checkpointed(rows)
    chunks = F.ceil(F.col("n") / LIST_CHUNK).cast("long")
    long_enough = rows.groupBy("value").agg(F.count("*").alias("n")).where("n > 1")
    return rows.join(long_enough.select("value", chunks.alias("chunks")), "value")


def _matrix(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    sizes = lists.value_lengths().to_numpy()
    out = np.full((len(sizes), SKETCH), _FULL, np.int64)
    out[np.arange(SKETCH) < sizes[:, None]] = lists.flatten().to_numpy()
    return out, sizes


def estimates_pass(a: np.ndarray, b: np.ndarray, whole: np.ndarray, percent: int) -> np.ndarray:
    """Which rows of two sketch matrices may be linked; ``whole``: both hold the entire set.

    Up to the smaller of the two largest retained values both sketches are complete, so
    there the union and the intersection are counted, not guessed.
    """
    end = np.minimum(a[:, -1], b[:, -1])[:, None]
    both = np.sort(np.concatenate((a, b), axis=1), axis=1)
    inside = (both <= end) & (both < _FULL)
    common = (inside[:, 1:] & (both[:, 1:] == both[:, :-1])).sum(axis=1)
    union = inside.sum(axis=1) - common
    low = np.where(whole, percent, percent - 100 * slack(percent))
    return 100 * common >= low * union


def candidate_links(lists: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """``a, b``: links that connect the classes of each list whose estimates pass."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: list[pa.Table] = []
        for group in groups(batches, 3):
            if group.num_rows == 2:
                pairs.append(group)
                if len(pairs) == 2000:
                    yield of_pairs(pairs)
                    pairs = []
            elif group.num_rows > 2:
                yield of_group(group)
        if pairs:
            yield of_pairs(pairs)

    def of_pairs(pairs: list[pa.Table]) -> pa.RecordBatch:
        table = pa.concat_tables(pairs)
        rows, _ = _matrix(table["sketch"].combine_chunks())
        ids, whole = table["id"].to_numpy(), table["whole"].to_numpy()
        hit = estimates_pass(rows[::2], rows[1::2], whole[::2] & whole[1::2], percent)
        return edge_batch(list(set(zip(ids[::2][hit].tolist(), ids[1::2][hit].tolist(), strict=True))))

    def of_group(group: pa.Table) -> pa.RecordBatch:
        rows, _ = _matrix(group["sketch"].combine_chunks())
        ids, whole = group["id"].to_pylist(), group["whole"].to_numpy()

        def linked(x: int, unseen: np.ndarray) -> np.ndarray:
            others = np.flatnonzero(unseen)
            hit = np.zeros(len(others), bool)
            for at in range(0, len(others), 2048):  # bounds the memory of a step
                part = others[at : at + 2048]
                one = np.broadcast_to(rows[x], (len(part), SKETCH))
                hit[at : at + 2048] = estimates_pass(one, rows[part], whole[part] & whole[x], percent)
            return others[hit]

        return edge_batch([(ids[x], ids[y]) for x, y in spanning(len(ids), linked)])

    with_sketch = dealt(lists, "id", "chunks").join(classes.select("id", "whole", "sketch"), "id")
    keys = ["value", "i", "j"]
    rows = with_sketch.select(*keys, "id", "whole", "sketch")
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lean(link), "a long, b long")


def near_dedup(documents: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Per row ``doc_id, n_shingles, component_id, kept``."""
    rows = checkpointed(sketches(documents, width))
    classes = checkpointed(
        rows.where("doc_id IS NOT NULL AND n_shingles > 0")
        .groupBy("set_id")
        .agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
        .select("set_id", "id", "n", (F.col("n") <= SKETCH).alias("whole"), "sketch")
    )
    lists = listed(classes, percent)
    clusters = components(candidate_links(lists, classes, percent))
    links = exact_links(_met_sets(documents, clusters, classes, width, percent), percent)
    linked = components(links).select("id", "component")
    named = classes.select("set_id", "id").join(linked, "id", "left")
    named = named.select("set_id", F.coalesce("component", "id").alias("component_id"))
    own = F.coalesce("component_id", "doc_id")
    return rows.select("doc_id", "n_shingles", "set_id").join(named, "set_id", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), own).alias("component_id"),
        F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def _met_sets(documents: DataFrame, clusters: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """The meetings of the classes in clusters with their full sets, read from the texts again."""
    members = clusters.withColumnRenamed("component", "cluster").join(classes.select("id", "set_id", "n"), "id")
    met = checkpointed(meetings(members.withColumn("weight", F.col("n")), percent, CHUNK))
    wanted = Bits(met.selectExpr(f"id & {_FULL}L AS id"))
    named = classes.select("id", "set_id")
    sets = shingle_sets(documents, width, wanted).dropDuplicates(["id", "set_id"]).join(named, ["id", "set_id"])
    return met.join(sets.select("id", "set"), "id")

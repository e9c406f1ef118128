"""Fuzzy line deduplication over all documents by MinHash.

A line is compared as its words in lower case (A-Z) with single spaces between. Lines with
equal words are one item. ``BANDS`` bands of ``ROWS`` minimum hashes over character shingles
make candidates: a pair at the threshold of 0.8 shares a band with a chance of 0.9997. The distinct lines of
a band are a group; of groups with the same members in several bands one is looked at. Exact
Jaccard on the full shingle sets confirms links inside each group, before anything is joined, so unlike
lines are never chained into one candidate cluster. A group is streamed, and only one too large for a
task is cut by size and dealt to chunks. A distributed union joins the confirmed links. The first line of a
component, by ``doc_id`` and place, stays; the others go.

Shingles are runs of ``WIDTH`` bytes of UTF-8; lines are known by 63-bit hashes.
One changed inner byte touches ``WIDTH`` shingles, so a line of distinct shingles is linked with such a copy
from 79 bytes on; shorter ones are linked only if they differ less, for most of them only if their words are equal.

Defined results: blank lines stay; a line shorter than a shingle only equals itself; null texts
stay null; rows that repeat a ``doc_id`` count as one document, whose first line stays in each
of them; rows without ``doc_id`` come back as they are; an empty table gives no rows; all
columns but the text are returned unchanged, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadsieve.llm.hashing import char_shingle_sets, char_shingles, mixed, runs
from leadsieve.llm.linking import exact_links, whole_or_met
from leadsieve.llm.tables import Bits, components, forget, lean, raw_texts, slices, written

WIDTH, PERCENT = 8, 80
BANDS, ROWS = 12, 3

#: Shingles that one chunk of a group holds on average.
CHUNK = 1_000_000

#: Lines that a task remembers in order not to send them again.
SEEN = 100_000

_A = np.random.default_rng(31).integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_B = np.random.default_rng(32).integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)

_BLANKS = bytes.maketrans(b"\t\r\x0b\x0c", b"    ")


def normal_lines(text: bytes) -> list[bytes]:
    """The words of every line with single spaces between, A-Z in lower case; empty for a blank line."""
    out = []
    for line in text.lower().translate(_BLANKS).split(b"\n"):
        line = line.strip(b" ")
        out.append(b" ".join(line.split()) if b"  " in line else line)
    return out


def line_key(words: bytes) -> int:
    return xxhash.xxh3_64_intdigest(words) >> 1


def band_keys(lines: list[bytes], width: int) -> np.ndarray:
    """A row per line of at least ``width`` bytes, a column per band."""
    out = [_minima(run, width) for run in runs(lines)]
    if not out:
        return np.zeros((0, BANDS), np.uint64)
    least = np.concatenate(out, axis=1)
    keys = np.empty((len(lines), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(lines), b + 1, np.uint64)
        for row in least[b * ROWS : (b + 1) * ROWS]:
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + row)
        keys[:, b] = key >> np.uint64(1)
    return keys


def _minima(lines: list[bytes], width: int) -> np.ndarray:
    """The smallest hash of each line (columns) under each of the hash functions (rows)."""
    codes = (char_shingles(lines, width) >> np.uint64(32)).astype(np.uint32)
    codes = np.append(codes, np.uint32(0))
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    begin = np.cumsum(sizes) - sizes
    edges = np.column_stack((begin, begin + sizes - width + 1)).ravel()
    least = np.empty((BANDS * ROWS, len(lines)), np.uint32)
    hashed = np.empty_like(codes)
    for i in range(BANDS * ROWS):
        np.multiply(codes, _A[i], out=hashed)
        np.add(hashed, _B[i], out=hashed)
        least[i] = np.minimum.reduceat(hashed, edges)[::2]
    return least


def _new_lines(part: pa.RecordBatch, seen: set[int]) -> tuple[list[int], list[bytes]]:
    ids, lines = [], []
    for text in raw_texts(part.column("text")):
        for words in normal_lines(text):
            if words and (key := line_key(words)) not in seen:
                seen.add(key)
                ids.append(key)
                lines.append(words)
    if len(seen) > SEEN:
        seen.clear()
    return ids, lines


def band_members(documents: DataFrame, width: int) -> DataFrame:
    """``key, id, n, name``: the distinct lines of every band that several share.

    The last row of a group has no ``id`` but the number of its members and a name that equal groups share.
    """

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                found = zip(*_new_lines(part, seen), strict=True)
                found = [(i, x) for i, x in found if len(x) >= width]
                if not found:
                    continue
                ids = np.array([i for i, _ in found], np.int64)
                keys = band_keys([x for _, x in found], width).astype(np.int64).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(ids, BANDS))], names=["key", "id"])

    texts = documents.where("doc_id IS NOT NULL").select("text")
    rows = texts.mapInArrow(lean(banded), "key long, id long")
    # most keys are alone: a sort by one number, which Spark does by its digits, finds these, and few are sorted by both
    dealt = rows.repartition("key").sortWithinPartitions("key")
    few = dealt.mapInArrow(lean(not_alone), "key long, id long").sortWithinPartitions("key", "id")
    return few.mapInArrow(lean(shared_bands), "key long, id long, n long, name long")


def not_alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``key, id``, in order of ``key``, that stand next to a row with the same key."""
    last, found = None, False
    for batch in batches:
        key, id_ = batch.column("key").to_numpy(), batch.column("id").to_numpy()
        if last is not None:  # whether the last row is alone shows only now
            key, id_ = np.concatenate(([last[0]], key)), np.concatenate(([last[1]], id_))
        if not len(key):
            continue
        same = key[1:] == key[:-1]
        shared = np.concatenate(([found], same))
        shared[:-1] |= same
        last, found = (key[-1], id_[-1]), bool(shared[-1])
        shared[-1] = False
        yield _key_rows(key[shared], id_[shared])
    if found:
        yield _key_rows(*(np.array([x]) for x in last))


def _key_rows(keys: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, pa.int64())], names=["key", "id"])


def shared_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of two ids or more among ``key, id`` in order; no group is held, however large."""
    open_key, open_id, open_n, open_name = None, 0, 0, np.uint64(0)
    for batch in batches:
        key, id_ = batch.column("key").to_numpy(), batch.column("id").to_numpy()
        if open_key is not None:  # the group that may go on comes first again, as its last id
            key, id_ = np.concatenate(([open_key], key)), np.concatenate(([open_id], id_))
        if not len(key):
            continue
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (id_[1:] != id_[:-1])))
        key, id_ = key[new], id_[new]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        n = np.diff(np.append(first, len(key)))
        names = np.add.reduceat(mixed(id_.astype(np.uint64)), first)
        carried = open_n if open_key is not None else 0
        if carried:  # all but its last id have been counted and named before
            n[0] += carried - 1
            names[:1] += open_name
            names[:1] -= mixed(id_[:1].astype(np.uint64))
        # of the last group the last id waits for what follows, and goes out with it
        shared = np.repeat(n > 1, np.diff(np.append(first, len(key))))
        if carried > 1:
            shared[0] = False  # is out already
        done = np.flatnonzero(n[:-1] > 1)
        yield _band_rows(key[shared], id_[shared], key[first[done]], n[done], names[done])
        open_key, open_id, open_n, open_name = key[-1], id_[-1], int(n[-1]), names[-1]
    if open_key is not None and open_n > 1:
        yield _band_rows(np.zeros(0, np.int64), np.zeros(0, np.int64), *(np.array([x]) for x in (open_key, open_n, open_name)))


def _band_rows(keys, ids, done_keys, n, names) -> pa.RecordBatch:
    nothing, none = [None] * len(keys), [None] * len(done_keys)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate((keys, done_keys)), pa.int64()),
            pa.chunked_array([pa.array(ids, pa.int64()), pa.array(none, pa.int64())]).combine_chunks(),
            pa.chunked_array([pa.array(nothing, pa.int64()), pa.array(n, pa.int64())]).combine_chunks(),
            pa.chunked_array([pa.array(nothing, pa.int64()), pa.array(names.astype(np.uint64).view(np.int64))]).combine_chunks(),
        ],
        names=["key", "id", "n", "name"],
    )


def groups_once(bands: DataFrame) -> DataFrame:
    """``cluster, id``: the members of the bands, each set of members once."""
    ends = bands.where("id IS NULL").groupBy("n", "name").agg(F.min("key").alias("cluster"))
    members = bands.where("id IS NOT NULL").select(F.col("key").alias("cluster"), "id")
    return members.join(ends.select("cluster"), "cluster")


def line_places(documents: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """``doc_id, line, id, n, words`` of every line that is not blank.

    ``words`` and the size ``n`` of their set are given where a task first meets a line that ``ids`` may hold.
    """
    wanted = Bits(ids)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                docs, at, ids, fresh, lines = [], [], [], [], []
                for k, text in enumerate(raw_texts(part.column("text"))):
                    for i, words in enumerate(normal_lines(text)):
                        if words:
                            key = line_key(words)
                            if key not in seen:
                                seen.add(key)
                                fresh.append(len(ids))
                                lines.append(words)
                            docs.append(k)
                            at.append(i)
                            ids.append(key)
                if len(seen) > SEEN:
                    seen.clear()
                keys = np.array(ids, np.int64)
                hit = np.flatnonzero(wanted.has(keys[fresh].astype(np.uint64))).tolist()
                sizes = char_shingle_sets([lines[i] for i in hit], width)[1].tolist()
                n, words = [None] * len(ids), [None] * len(ids)
                for i, size in zip(hit, sizes, strict=True):
                    n[fresh[i]], words[fresh[i]] = size, lines[i]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(docs, pa.int64())),
                        pa.array(at, pa.int32()),
                        pa.array(keys),
                        pa.array(n, pa.int32()),
                        pa.array(words, pa.binary()),
                    ],
                    names=["doc_id", "line", "id", "n", "words"],
                )

    rows = documents.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lean(places), "doc_id long, line int, id long, n int, words binary")


def line_components(bands: DataFrame, places: DataFrame, width: int, percent: int) -> DataFrame:
    """``id, component`` of the lines that are linked with others; from ``groups_once`` and ``line_places``."""
    # equal ids have equal words, so this is one row for each
    lines = places.where("words IS NOT NULL").select("id", "n", "words").distinct()
    lines = written(lines.join(bands.select("id").distinct(), "id", "left_semi"))
    weighed = written(bands.join(lines.select("id", F.col("n").alias("weight"), "n"), "id"))
    met = whole_or_met(weighed, percent, CHUNK)

    def sets_of(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return char_shingle_sets(lines.to_pylist(), width)

    links = exact_links(met.join(lines.select("id", F.col("words").alias("set")), "id"), percent, sets_of)
    linked = components(links)
    forget(bands.sparkSession, [lines, weighed])
    return linked


def removed_lines(documents: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``doc_id, removed``: per document the numbers of its lines that go."""
    shared = written(band_members(documents, width))
    bands = written(groups_once(shared))
    places = written(line_places(documents, bands.select("id"), width))
    linked = line_components(bands, places, width, percent)
    # document and line in one number of fixed width, so that a hash aggregate finds the first before the shuffle
    place = F.col("doc_id").cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)") + F.col("line")
    named = places.select("doc_id", "line", "id", place.cast("decimal(38,0)").alias("place"))
    equal = named.groupBy("id").agg(F.min("place").alias("first"), F.count("*").alias("n")).join(linked, "id", "left")
    # most lines are like no other; what is left is small
    like = written(equal.where("component IS NOT NULL OR n > 1").withColumn("component", F.coalesce("component", "id")))
    first = like.groupBy("component").agg(F.min("first").alias("first"), F.sum("n").alias("n")).where("n > 1")
    gone = named.join(like.select("id", "component").join(first, "component"), "id").where("place != first")
    forget(documents.sparkSession, [shared, bands])
    return gone.groupBy("doc_id").agg(F.collect_set("line").alias("removed"))


def line_dedup(documents: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The documents with their texts as they remain, and ``n_lines``, ``n_removed`` in a struct ``lines``.

    The columns of ``documents`` are in a struct ``document``.
    """
    removed = removed_lines(documents, width, percent).withColumnRenamed("doc_id", "id")
    rows = documents.select(F.struct(*[documents[f"`{c.replace("`", "``")}`"] for c in documents.columns]).alias("document"))
    joined = rows.join(removed, F.col("document.doc_id") == F.col("id"), "left")
    keep = F.expr(
        r"""transform(array(split(document.text, '\n')), ls -> array_join(
              transform(array_except(sequence(0, size(ls) - 1), removed), i -> ls[i]), '\n'))[0]"""
    )
    text = F.when(F.col("removed").isNull(), F.col("document.text")).otherwise(keep)
    counts = F.struct(
        F.size(F.split("document.text", "\n")).cast("long").alias("n_lines"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
    )
    return joined.select(F.col("document").withField("text", text).alias("document"), counts.alias("lines"))

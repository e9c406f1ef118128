"""Exact deduplication with cuckoo-filter indexes of live digests.

Every shard of the digest space is one cuckoo index. A digest whose fingerprint is not
in the filter is new. A fingerprint hit is verified against the digests stored in the
two buckets, so a false positive costs a comparison and never a row. The live digest of
a group moves to a larger ``doc_id`` by deleting the old entry and inserting the new one. When
an insertion finds no room the index doubles and is refilled from its stored keys.

Each task first runs its own rows through an index, so a text that a third of all rows
share reaches its shard as one row per task.

Defined results: null text counts as the empty text; rows of a group are counted even if
they repeat a ``doc_id``, and every row that has the kept ``doc_id`` is kept; a row without
``doc_id`` is kept only if no row of its group has one; an empty table gives no rows. Other
columns of ``documents`` are not looked at. SHA-256 digests stand for the texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 4
MAX_KICKS = 200
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

STORED, INSERTED, DELETED = 0, 1, 2
_LIVE = "digest binary, doc_id long, copies long"
_LIVE_ARROW = pa.schema([("digest", pa.binary()), ("doc_id", pa.int64()), ("copies", pa.int64())])


class CuckooIndex:
    """Fingerprints in buckets of four slots, with the full key and its entry beside each."""

    def __init__(self, buckets: int = 1024):
        self._reset(buckets)

    def _reset(self, buckets: int) -> None:
        self.buckets = buckets
        self.prints = [0] * (buckets * SLOTS)
        self.entries: list[tuple[bytes, int | None, int] | None] = [None] * (buckets * SLOTS)
        self.resizes = getattr(self, "resizes", -1) + 1

    def _places(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[:2], "little") or 1
        first = int.from_bytes(key[2:10], "little") & (self.buckets - 1)
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ (mark * 0x5BD1E995 & (self.buckets - 1))

    def find(self, key: bytes) -> int:
        """The slot of ``key``, -1 if it is not live."""
        mark, first, second = self._places(key)
        for bucket in (first, second):
            at = bucket * SLOTS
            for slot in range(at, at + SLOTS):
                if self.prints[slot] == mark and self.entries[slot][0] == key:
                    return slot
        return -1

    def insert(self, key: bytes, doc_id: int | None, copies: int) -> None:
        """Add a key that is not live."""
        left = self._placed((key, doc_id, copies))
        if left is None:
            return
        stored = [*self, left]
        while left is not None:
            self._reset(self.buckets * 2)
            left = next((e for e in map(self._placed, stored) if e is not None), None)

    def _placed(self, entry):
        """Store ``entry``; the entry that is left over if no free slot turned up."""
        mark, bucket, second = self._places(entry[0])
        for b in (bucket, second):
            at = b * SLOTS
            for slot in range(at, at + SLOTS):
                if not self.prints[slot]:
                    self.prints[slot], self.entries[slot] = mark, entry
                    return None
        for kick in range(MAX_KICKS):
            slot = bucket * SLOTS + kick % SLOTS
            mark, self.prints[slot] = self.prints[slot], mark
            entry, self.entries[slot] = self.entries[slot], entry
            bucket = self._other(bucket, mark)
            at = bucket * SLOTS
            for slot in range(at, at + SLOTS):
                if not self.prints[slot]:
                    self.prints[slot], self.entries[slot] = mark, entry
                    return None
        return entry

    def delete(self, key: bytes) -> tuple[bytes, int | None, int] | None:
        """Take a live key out; its entry, or ``None`` if it was not live."""
        slot = self.find(key)
        if slot < 0:
            return None
        entry, self.prints[slot], self.entries[slot] = self.entries[slot], 0, None
        return entry

    def absorb(self, key: bytes, doc_id: int | None, copies: int) -> None:
        """One more row (or ``copies`` of them): the largest ``doc_id`` stays live."""
        slot = self.find(key)
        if slot < 0:
            self.insert(key, doc_id, copies)
            return
        _, live, n = self.entries[slot]
        if doc_id is None or (live is not None and live >= doc_id):
            self.entries[slot] = (key, live, n + copies)
        else:
            self.delete(key)
            self.insert(key, doc_id, n + copies)

    def __iter__(self) -> Iterator[tuple[bytes, int | None, int]]:
        return (e for e in self.entries if e is not None)


def _emit(index: Iterable[tuple[bytes, int | None, int]]) -> Iterator[pa.RecordBatch]:
    rows = list(index)
    for i in range(0, len(rows), 50_000):
        columns = zip(*rows[i : i + 50_000], strict=True)
        arrays = [pa.array(c, f.type) for c, f in zip(columns, _LIVE_ARROW, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, schema=_LIVE_ARROW)


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = CuckooIndex()
    for batch in batches:
        digests, ids, copies, kinds = (c.to_pylist() for c in batch.columns)
        for key, doc_id, n, kind in zip(digests, ids, copies, kinds, strict=True):
            if kind == DELETED:
                index.delete(key)
            else:
                index.absorb(key, doc_id, n)
    yield from _emit(index)


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def digests(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(F.sha2(normalised(F.col("text")).cast("binary"), 256)).alias("digest"),
    )


def live_digests(documents: DataFrame) -> DataFrame:
    """``digest, doc_id, copies``: one live entry per text, from an index per shard."""
    rows = digests(documents).select(
        "digest", "doc_id", F.lit(1).cast("long").alias("copies"), F.lit(INSERTED).alias("kind")
    )
    local = rows.mapInArrow(_indexed, _LIVE)
    return _sharded(local.withColumn("kind", F.lit(INSERTED)))


def updated(live: DataFrame, inserted: DataFrame, deleted: DataFrame) -> DataFrame:
    """The live digests after withdrawing the texts of ``deleted`` and then adding ``inserted``.

    ``live`` is a stored result of ``live_digests``; a withdrawn text counts as new when it comes again.
    """
    stored = live.select("digest", "doc_id", "copies", F.lit(STORED).alias("kind"), F.lit(0).alias("turn"))
    gone = digests(deleted).select(
        "digest", "doc_id", F.lit(0).cast("long").alias("copies"), F.lit(DELETED).alias("kind"), F.lit(1).alias("turn")
    )
    new = live_digests(inserted).select(
        "digest", "doc_id", "copies", F.lit(INSERTED).alias("kind"), F.lit(2).alias("turn")
    )
    rows = stored.unionByName(gone.dropDuplicates(["digest"])).unionByName(new)
    return _sharded(rows, "turn")


def _sharded(rows: DataFrame, *order: str) -> DataFrame:
    shards = rows.repartition("digest")
    if order:
        shards = shards.sortWithinPartitions(*order)
    return shards.select("digest", "doc_id", "copies", "kind").mapInArrow(_indexed, _LIVE)


def exact_dedup(documents: DataFrame) -> DataFrame:
    """Per row ``doc_id, keep_id, group_size, kept, text_sha256``; the largest id of equal texts stays."""
    live = live_digests(documents).select(
        "digest", F.col("doc_id").alias("keep_id"), F.col("copies").alias("group_size")
    )
    return (
        digests(documents)
        .join(live, "digest")
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )

"""SimHash near-duplicates by meet-in-the-middle ball hashing.

1. A document's fingerprint holds the majority of every bit over the XXH64 hashes (seed 42) of
   its word shingles, repeats included. Equal fingerprints are one item from here on.
2. Two fingerprints that differ in up to ``RADIUS`` = 3 bits have a variant in the middle, one bit
   from one of them and at most two from the other. Differing in one or three bits, they
   differ in the parity of their set bits as well, so those of even parity emit their ball of
   radius one, those of odd parity that of radius two; two of one parity differ in two bits
   and share variants at distance one. Of three differing bits two lie in the same half of
   the fingerprint, so the outer shell needs flips of two bits of one half alone:
   65 variants are emitted for even parity and 1,057 for odd.
3. Variants are shuffled, packed into shards by their hash, ten bytes each: the variant and the number
   of the flip that leads back. A variant's group holds at most 2,081 fingerprints, however many
   documents there are. What lies within one bit of the variant is within three bits of all
   others, so the group is linked as a star around one such member, after its distances are verified.
4. Links are deduplicated and joined by a distributed union; a component's name is its smallest ``doc_id``.

The number of shards grows with the number of fingerprints, so a task's share of variants does not.

Words are ``[^\\x20\\x09-\\x0D]+`` after A-Z became lower case; fewer words than a shingle are
one shingle. Defined results: null, empty and blank texts have fingerprint zero and are
linked like any other; a bit with exactly half the hashes is not set; rows that repeat a
``doc_id`` are fingerprinted one by one; a row without ``doc_id`` gets its component's smallest
``doc_id``, null if no member has one; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadsieve.llm.hashing import mixed
from leadsieve.llm.tables import checkpointed, components, forget, lowered, slices, written

WIDTH = 3
RADIUS = 3
BITS = 64
SEED = 42

#: Fingerprints whose balls a task packs at a time; a shard gets one row of each.
PACK = 4096

#: Variants that a shard holds on average.
SHARD = 2_000_000

_HALF = BITS // 2
_PAIRS = [p for low in (0, _HALF) for p in combinations(range(low, low + _HALF), 2)]

#: The flips of a ball, the centre first, then single bits, then two bits of one half.
FLIPS = np.array([0, *(1 << i for i in range(BITS)), *((1 << i) | (1 << j) for i, j in _PAIRS)], np.uint64)
INNER = 1 + BITS

_PACKED = np.dtype([("variant", "<u8"), ("flip", "<u2")])


def shingle_hashes(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every word shingle of the texts, one text after another, and their numbers."""
    split = [t.split() for t in texts]
    words = [w for ws in split for w in ws]
    n_words = np.fromiter(map(len, split), np.int64, len(split))
    del split
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words)]
    sizes = np.where(n_words > 0, np.maximum(1, n_words - width + 1), 0)
    begin = np.cumsum(n_words) - n_words
    at = np.arange(sizes.sum()) + np.repeat(begin - np.cumsum(sizes) + sizes, sizes)
    last = at + np.repeat(np.minimum(n_words, width), sizes) - 1
    spans = zip(starts[at].tolist(), ends[last].tolist(), strict=True)
    digests = b"".join([xxhash.xxh64_digest(joined[a:b], SEED) for a, b in spans])
    return np.frombuffer(digests, ">u8").astype(np.uint64), sizes


def majorities(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per run of ``sizes`` hashes the bits that are set in over half of them; 0 for an empty run."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(hashes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    starts = np.flatnonzero(place % 255 == 0)  # a byte counts to 255
    out = np.zeros(len(sizes), np.uint64)
    if not len(starts):
        return out
    block_owner = owner[starts]
    counts = np.zeros((len(sizes), 8), np.int64)
    for shift in range(8):  # the bits at one place of all bytes are counted side by side
        bytewise = (hashes >> np.uint64(shift)) & np.uint64(0x0101010101010101)
        blocks = np.add.reduceat(bytewise, starts).astype("<u8").view(np.uint8).reshape(-1, 8)
        counts[:] = 0
        np.add.at(counts, block_owner, blocks)
        for byte in range(8):
            over = (2 * counts[:, byte] > sizes).astype(np.uint64)
            out |= over << np.uint64(8 * byte + shift)
    return out


def text_fingerprints(texts: list[bytes], width: int = WIDTH) -> np.ndarray:
    """The fingerprints of texts in lower case."""
    return majorities(*shingle_hashes(texts, width))


def fingerprints(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, fp`` of every row; ``fp`` is the fingerprint as a signed long."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = text_fingerprints(lowered(part.column("text")), width)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"]
                )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(cut, "doc_id long, fp long")


def balls(fps: np.ndarray) -> np.ndarray:
    """The variants of all fingerprints with the numbers of their flips."""
    odd = np.bitwise_count(fps) % 2 == 1
    out = []
    for some, flips in ((fps[~odd], FLIPS[:INNER]), (fps[odd], FLIPS)):
        ball = np.empty((len(some), len(flips)), _PACKED)
        ball["variant"] = some[:, None] ^ flips
        ball["flip"] = np.arange(len(flips))
        out.append(ball.ravel())
    return np.concatenate(out)


def stars(ball: np.ndarray) -> np.ndarray:
    """Links, two columns of fingerprints, between those that meet in a variant."""
    ball = ball[np.lexsort((ball["flip"], ball["variant"]))]
    variant = ball["variant"]
    first = np.concatenate(([True], variant[1:] != variant[:-1])) if len(ball) else np.zeros(0, bool)
    hub = np.flatnonzero(first)[np.cumsum(first) - 1]  # the smallest flip of each variant
    fps = variant ^ FLIPS[ball["flip"]]
    met = ~first & (ball["flip"][hub] < INNER)
    links = np.column_stack((fps[hub[met]], fps[met]))
    return np.unique(links[np.bitwise_count(links[:, 0] ^ links[:, 1]) <= RADIUS], axis=0)


def shard_of(variants: np.ndarray, shards: int) -> np.ndarray:
    return (mixed(variants) % np.uint64(shards)).astype(np.int64)


def fingerprint_links(fps: DataFrame, shards: int) -> DataFrame:
    """``a, b``: links that connect all ``fp`` (distinct) within ``RADIUS`` bits of each other."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PACK):
                ball = balls(batch.column("fp").slice(at, PACK).to_numpy().view(np.uint64))
                shard = shard_of(ball["variant"], shards)
                order = np.argsort(shard, kind="stable")
                used, begin = np.unique(shard[order], return_index=True)
                packed = ball[order]
                rows = [p.tobytes() for p in np.split(packed, begin[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(rows, pa.binary())], names=["shard", "ball"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        last = None
        for batch in batches:
            for shard, ball in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and shard != last:
                    yield linked(held)
                    held = []
                held.append(ball)
                last = shard
        if held:
            yield linked(held)

    def linked(held: list[bytes]) -> pa.RecordBatch:
        links = stars(np.frombuffer(b"".join(held), _PACKED)).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["a", "b"])

    packed = fps.select("fp").mapInArrow(emit, "shard long, ball binary")
    dealt = packed.repartition(shards, "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(meet, "a long, b long").distinct()


def simhash_dedup(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per row ``doc_id, fingerprint, component_id, kept``."""
    rows = checkpointed(fingerprints(documents, width))
    classes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("id")))
    variants = classes.count() * (INNER + len(FLIPS)) // 2
    linked = components(fingerprint_links(classes, 1 + variants // SHARD))
    named = classes.join(linked.toDF("fp", "component"), "fp", "left")
    named = named.withColumn("component", F.coalesce("component", "fp"))
    smallest = named.groupBy("component").agg(F.min("id").alias("component_id"))
    of_fp = checkpointed(named.join(smallest, "component").select("fp", "component_id"))
    forget(documents.sparkSession, [classes, linked])
    return rows.join(of_fp, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), BITS // 4, "0")).alias("fingerprint"),
        "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )

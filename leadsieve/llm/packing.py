"""Best-fit packing with certified bin counts.

Documents become token ids by a public byte-level BPE and an end token; only their lengths
and checksums travel. Pieces of the full length fill a sequence alone. The others are
dealt to partitions of bounded size, each packed by best-fit decreasing. Dual-feasible
functions give a lower bound on the bins a partition's lengths need; a partition that
meets its bound is certified and stays as it is, except for its emptiest bin. Partitions
with a gap hand the documents of their unfilled bins to a pool, the emptiest bins of certified
partitions join them, and the pool is dealt anew and packed again, until it is one partition, the bins
meet the bound of all lengths, or a round did not lower their number; the better of the last two rounds
stands then. Partitions, bins and bound of every round are logged; bins above the bound are uncertified.

Defined results: null and empty texts are one end token; rows are packed one by one even if
they repeat a ``doc_id`` or have none; equal lengths are placed in order of row; an empty table
gives no rows; other columns are not looked at. A text of any length is tokenised whole.
"""

from __future__ import annotations

import base64
import itertools
import logging
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadsieve.llm.tables import checkpointed, lean, slices

CAPACITY = 1024
END = 2

#: Items that are packed together by one task.
ITEMS = 50_000

#: Encoded words that a Python worker remembers; others are encoded each time.
REMEMBERED = 400_000

_log = logging.getLogger(__name__)

_PIECE = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"

#: A space at either end or beside other white space: no safe place to cut.
#: White space in a row that only ``tokenizers`` is given.
LONG_GAP = 10_000

_LONG_GAP = re.compile(rf"\s{{{LONG_GAP}}}")
_BESIDE_SPACE = re.compile(r"^ | $|\s |\s\s")
_remembered: dict[tuple[str, str], dict[str, bytes]] = {}


def public_files() -> tuple[str, str]:
    """Where the byte-level BPE is, for both libraries."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(2)
def _encoders(files: tuple[str, str]):
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(files[1], "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding(
        "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    return Tokenizer.from_file(files[0]), fast


def token_ids(text: str, files: tuple[str, str]) -> bytes:
    """The ids of ``text`` as little-endian 32-bit numbers.

    The pre-tokeniser never joins what stands on both sides of a single space, so a text
    without runs of white space is cut there and each word is encoded once per
    worker. Both libraries give the same ids for letters up to U+024F; words with others, and
    texts that may name a special token, go to ``tokenizers``. So do texts with a run of ``LONG_GAP`` blanks or
    line breaks, as the other library's pattern runs out of stack on some hundred thousand of them.
    """
    known = _remembered.setdefault(files, {})
    if "<|" in text or _LONG_GAP.search(text):
        return _encoded(text, files, whole=True)
    if "\0" in text or _BESIDE_SPACE.search(text):
        return _encoded(text, files)
    out = []
    for unit in text.replace(" ", "\0 ").split("\0"):
        ids = known.get(unit)
        if ids is None:
            ids = _encoded(unit, files)
            if len(known) < REMEMBERED:
                known[unit] = ids
        out.append(ids)
    return b"".join(out)


def _encoded(text: str, files: tuple[str, str], whole: bool = False) -> bytes:
    exact, fast = _encoders(files)
    if whole or not text.isascii() and max(text) > "\u024f":
        ids = exact.encode(text, add_special_tokens=False).ids
    else:
        ids = fast.encode_ordinary(text)
    return np.array(ids, "<u4").tobytes()


def pieces(documents: DataFrame, files: tuple[str, str], capacity: int, end: int) -> DataFrame:
    """``doc_id, row, piece, start, length, ids_crc32`` of every piece."""
    last = np.array([end], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows: list[list] = [[] for _ in range(6)]
                columns = (part.column(c).to_pylist() for c in ("doc_id", "row", "text"))
                for doc_id, row, text in zip(*columns, strict=True):
                    ids = token_ids(text or "", files) + last
                    n = len(ids) // 4
                    edges = [0, *range(n % capacity or capacity, n, capacity), n]
                    for k, (a, b) in enumerate(zip(edges, edges[1:])):
                        values = (doc_id, row, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b]))
                        for column, v in zip(rows, values, strict=True):
                            column.append(v)
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                arrays = [pa.array(r, t) for r, t in zip(rows, types, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    arrays, names=["doc_id", "row", "piece", "start", "length", "ids_crc32"]
                )

    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), "text"
    )
    return rows.mapInArrow(lean(cut), _PIECE)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that ``lengths`` need at least, the best of three families of dual-feasible functions.

    With threshold t <= C/2 a length over C-t counts C and one under t counts 0 (t = 0: the plain
    sum); a length over C/2 counts C and one of C/2 counts half; and lengths count by how many
    of a smallest kept size they leave no room for.
    """
    return bound_of(np.bincount(lengths, minlength=capacity + 1).astype(np.int64), capacity)


def bound_of(n: np.ndarray, capacity: int) -> int:
    """``lower_bound`` of ``n[length]`` items of each length."""
    sizes = np.arange(capacity + 1)
    total = np.concatenate((np.cumsum((n * sizes)[::-1])[::-1], [0]))
    count = np.concatenate((np.cumsum(n[::-1])[::-1], [0]))
    t = np.arange(capacity // 2 + 1)
    middle = total[t] - total[capacity - t + 1]
    best = int((-(-(middle + count[capacity - t + 1] * capacity) // capacity)).max())
    half = 2 * count[capacity // 2 + 1] + (n[capacity // 2] if capacity % 2 == 0 else 0)
    best = max(best, int(-(-half // 2)))
    for k in range(1, capacity // 2 + 1):
        fit = capacity // k
        value = np.where(
            2 * sizes > capacity,
            2 * (fit - (capacity - sizes) // k),
            np.where(2 * sizes == capacity, fit, 2 * (sizes // k)),
        )
        best = max(best, int(-(-(n * value).sum() // (2 * fit))))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin and offset of each item, and the room each bin has left."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms, rooms = 0, []
    order = np.argsort(-lengths, kind="stable")
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        fitting = open_rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = with_room[room].pop()
            if not with_room[room]:
                open_rooms ^= 1 << room
        else:
            room, b = capacity, len(rooms)
            rooms.append(capacity)
        bins[i], offsets[i] = b, capacity - room
        rooms[b] = room - n
        if not with_room[room - n]:
            open_rooms |= 1 << room - n
        with_room[room - n].append(b)
    return bins, offsets, np.array(rooms, np.int64)


def packed(
    documents: DataFrame,
    files: tuple[str, str] | None = None,
    capacity: int = CAPACITY,
    end: int = END,
    items: int = ITEMS,
) -> DataFrame:
    """Per piece ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    cut = checkpointed(pieces(documents, files or public_files(), capacity, end))
    out = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    full = cut.where(F.col("length") == capacity).select(
        "*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    done, pool = [full.select(*out)], cut.where(F.col("length") < capacity)
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in pool.groupBy("length").count().collect():  # fewer than ``capacity`` rows
        counts[length] = n
    bound, settled, best = bound_of(counts, capacity), 0, None
    for turn in itertools.count():
        partitions = -(-pool.count() // items)
        if not partitions:
            break
        placed = checkpointed(_placed(pool, turn, partitions, capacity))
        opened = placed.where(F.col("offset") == 0)  # a row for each bin
        bins, stay = opened.agg(F.count("*"), F.count(F.when(~F.col("freed"), 1))).first()
        _log.info("round %d: %d partitions, %d bins, bound %d", turn, partitions, settled + bins, bound)
        whole = settled + bins, [*done, placed.select(*out)]
        gained = best is None or whole[0] < best[0]
        if best is None or whole[0] <= best[0]:
            best = whole
        if not gained or partitions == 1 or whole[0] == bound:
            break
        done.append(placed.where("NOT freed").select(*out))
        settled += stay
        pool = placed.where("freed").select(*cut.columns)
    if best:
        done = best[1]
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    return result


def _placed(pool: DataFrame, turn: int, partitions: int, capacity: int) -> DataFrame:
    """One round; ``freed`` marks what goes to the next one, if there is one."""

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by([("row", "ascending"), ("piece", "ascending")])
        lengths, p = group["length"].to_numpy(), group["p"][0].as_py()
        bins, offsets, rooms = best_fit(lengths, capacity)
        freed = np.zeros(len(rooms), bool)
        freed[rooms.argmax()] = True
        if len(rooms) > lower_bound(lengths, capacity):
            freed |= rooms > 0
        sequence = (((turn << 32) + p) << 20) + bins
        group = group.drop(["p"])
        for name, values in (("sequence_id", sequence), ("offset", offsets), ("freed", freed[bins])):
            group = group.append_column(name, pa.array(values))
        return group

    dealt = F.pmod(F.xxhash64("row", "piece", F.lit(turn)), F.lit(partitions))
    return (
        pool.withColumn("p", dealt)
        .groupBy("p")
        .applyInArrow(pack, _PIECE + ", sequence_id long, offset long, freed boolean")
    )

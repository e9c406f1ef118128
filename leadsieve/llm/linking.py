"""Exact linking inside candidate clusters, without writing out their pairs.

Sets that agree to p percent differ in size by that much at most, so a cluster is cut into
classes of size, and only neighbouring classes meet. What is still larger than one task may
hold is dealt to chunks, every two of which meet in one task; nothing is dropped and no
task holds more than two chunks.

Where sets meet, each is looked up by its rarest hashes alone: as many as it takes to share
one with every set that may be linked. Overlaps of those that do are counted on the full
sets. The search goes breadth first: what is linked with a visited member is visited next and
not compared again. Only the links that connect members are returned, one less than
there are members in a linked group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadsieve.llm.hashing import held, mixed
from leadsieve.llm.tables import lean

#: Bytes of small groups that are linked in one go, about.
TOGETHER = 1 << 19

#: Members of a group that are compared one by one; larger groups are searched by their rarest hashes.
SMALL = 32

#: Values that one set is compared with at a time, about.
AT_ONCE = 1 << 16

_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def dealt(members: DataFrame, item: str, chunks: str) -> DataFrame:
    """Rows repeated so that every two of their group's ``chunks`` meet: adds ``i`` and ``j``."""
    own = F.pmod(F.xxhash64(item), F.col(chunks))
    rows = members.withColumn("_own", own).withColumn(
        "_with", F.explode(F.sequence(F.lit(0).cast("long"), F.col(chunks).cast("long") - 1))
    )
    return rows.withColumns({"i": F.least("_own", "_with"), "j": F.greatest("_own", "_with")}).drop("_own", "_with")


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows that agree in their first ``keys`` columns, of a partition sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in range(keys)]
        turn = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            turn |= c[1:] != c[:-1]
        edges = [0, *(np.flatnonzero(turn) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            now = tuple(c[a] for c in columns)
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*edges, strict=True) if edges else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_EDGES)


def spanning(n: int, linked) -> list[tuple[int, int]]:
    """Links that connect ``n`` members; ``linked(x, unseen)`` gives what x is linked with among the marked."""
    unseen, out = np.ones(n, bool), []
    for start in range(n):
        if not unseen[start]:
            continue
        unseen[start] = False
        queue = [start]
        while queue:
            x = queue.pop()
            found = linked(x, unseen)
            unseen[found] = False
            found = found.tolist()
            out += [(x, y) for y in found]
            queue += found
    return out


def by_rarest(values: np.ndarray, sizes: np.ndarray, percent: int):
    """``linked`` over full sets that lie one after another in ``values``, each in order."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    begin = np.concatenate(([0], np.cumsum(sizes)))
    # how often a value occurs, or more where others share its slot: any order will do
    # as long as it is the same for all sets, and equals stay in order of value
    slots = mixed(values.astype(np.uint64)) & np.uint64((1 << max(4, len(values).bit_length())) - 1)
    often = np.minimum(np.bincount(slots.astype(np.int64))[slots], (1 << 20) - 1)
    order = np.argsort((owner << 20) | often, kind="stable")
    take = sizes + 1 + (-percent * sizes // 100)  # n - ceil(p * n) + 1
    rare = order[np.arange(len(order)) - begin[owner] < take[owner]]
    rare = rare[often[rare] > 1]
    _, codes, lengths = np.unique(values[rare], return_inverse=True, return_counts=True)
    rare, codes = rare[lengths[codes] > 1], codes[lengths[codes] > 1]
    first_own = np.searchsorted(owner[rare], np.arange(len(sizes) + 1)).tolist()
    holders = owner[rare[np.argsort(codes, kind="stable")]]
    first = np.searchsorted(np.sort(codes), np.arange(len(lengths) + 1))
    del slots, often, order, owner  # the search needs none of them

    def linked(x: int, unseen: np.ndarray) -> np.ndarray:
        own = codes[first_own[x] : first_own[x + 1]].tolist()
        if not own:
            return np.zeros(0, np.int64)
        met = np.concatenate([holders[first[c] : first[c + 1]] for c in own])
        met = np.unique(met[unseen[met]])
        near = (100 * sizes[met] >= percent * sizes[x]) & (100 * sizes[x] >= percent * sizes[met])
        met = met[near]
        if not len(met):
            return met
        mine = values[begin[x] : begin[x + 1]]
        near_x, at, ends = [], 0, np.cumsum(sizes[met])
        while at < len(met):  # as many sets at a time as stay in the processor's cache, or one
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
            some = met[at:end]
            common = _sums(_among(mine, values[_spans(begin, sizes, some)]), sizes[some])
            near_x.append(some[100 * common >= percent * (sizes[x] + sizes[some] - common)])
            at = end
        return np.concatenate(near_x)

    return linked


def _among(known: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Which of ``asked`` are in ``known``, which is in order and not empty."""
    at = np.searchsorted(known, asked)
    at[at == len(known)] = 0
    return known[at] == asked


def _sums(marks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many are marked in each run of ``sizes``."""
    so_far = np.concatenate(([0], np.cumsum(marks)))
    ends = np.cumsum(sizes)
    return so_far[ends] - so_far[ends - sizes]


def apart(values: np.ndarray, sizes: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """The sets' values made different in different groups (``groups``: one number a set); each set stays in order."""
    owner = np.repeat(groups.astype(np.uint64), sizes)
    if len(groups) and groups[-1] < 1 << 20 and int(values.max(initial=0)) < 1 << 43:
        return values | (owner << np.uint64(43))
    values = mixed(values + owner * np.uint64(0x9E3779B97F4A7C15))
    return values[np.lexsort((values, np.repeat(np.arange(len(sizes)), sizes)))]


def side_by_side(values: np.ndarray, sizes: np.ndarray, members: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (two columns of places) that connect the groups of up to ``SMALL`` sets, and the members of larger ones.

    ``members`` are the groups' numbers of sets, one group after another; groups share no value. All
    groups are searched at once, a step of each at a time: the next set of what is linked so far, or else the
    next that is left, is compared with all that are left and near it in size.
    """
    n, group = len(sizes), np.repeat(np.arange(len(members)), members)
    begin = np.cumsum(sizes) - sizes
    unseen, waiting = (members <= SMALL)[group], np.zeros(n, bool)
    rest, links = np.flatnonzero(~unseen), [np.zeros((0, 2), np.int64)]
    hub_of = np.full(len(members), -1)
    while unseen.any():
        hub_of[:] = -1
        for some in (unseen, waiting & np.isin(group, group[unseen])):
            at = np.flatnonzero(some)[::-1]
            hub_of[group[at]] = at  # of several the first one is left
        hubs = hub_of[hub_of >= 0]
        unseen[hubs] = waiting[hubs] = False
        left = np.flatnonzero(unseen)
        hub = hub_of[group[left]]
        near = 100 * np.minimum(sizes[left], sizes[hub]) >= percent * np.maximum(sizes[left], sizes[hub])
        left, hub = left[near], hub[near]
        if not len(left):
            continue
        found = held(values[_spans(begin, sizes, np.unique(hub))], values[_spans(begin, sizes, left)])
        common = _sums(found, sizes[left])
        linked = 100 * common >= percent * (sizes[left] + sizes[hub] - common)
        links.append(np.column_stack((hub[linked], left[linked])))
        unseen[left[linked]], waiting[left[linked]] = False, True
    return np.concatenate(links), rest


def _spans(begin: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Places of all values of the sets ``which``, one set after another."""
    n = sizes[which]
    return np.arange(n.sum()) + np.repeat(begin[which] - np.cumsum(n) + n, n)


def meetings(members: DataFrame, percent: int, chunk: int) -> DataFrame:
    """``cluster, g, i, j, id``: in which groups the ``members(cluster, id, n, weight)`` meet; ``n`` is a set's size."""
    step = math.log(100 / percent) * (1 + 1e-9)
    size_class = F.floor(F.log(F.col("n")) / step).cast("int")
    # class c is the lower one of group c and the upper one of group c - 1
    both = F.posexplode(F.array(size_class, size_class - 1)).alias("upper", "g")
    rows = members.select("cluster", both, "id", "weight")
    chunks = F.ceil(F.sum("weight") / chunk).cast("long")
    sums = rows.groupBy("cluster", "g").agg(
        chunks.alias("chunks"), F.count("*").alias("rows"), F.count_if(F.col("upper") == 0).alias("lower")
    )
    # where there is no lower class, the upper one meets in its own group
    met = rows.join(sums.where("rows > 1 AND lower > 0").select("cluster", "g", "chunks"), ["cluster", "g"])
    return dealt(met, "id", "chunks").select("cluster", "g", "i", "j", "id")


def whole_or_met(members: DataFrame, percent: int, chunk: int) -> DataFrame:
    """``cluster, g, i, j, id``: groups that one task can hold meet as they are, larger ones as in ``meetings``.

    A member whose set is too small or too large for all others of its group meets nobody.
    """
    sums = members.groupBy("cluster").agg(F.sum("weight").alias("sum"))
    large = sums.where(F.col("sum") > chunk).select("cluster")
    by_size = Window.partitionBy("cluster").orderBy("n", "id")
    n = F.col("n")
    near = (100 * F.lag("n").over(by_size) >= percent * n) | (percent * F.lead("n").over(by_size) <= 100 * n)
    small = members.join(large, "cluster", "left_anti").withColumn("near", near).where("near")
    zero = F.lit(0).cast("long")
    whole = small.select("cluster", F.lit(0).alias("g"), zero.alias("i"), zero.alias("j"), "id")
    return whole.unionByName(meetings(members.join(large, "cluster", "left_semi"), percent, chunk))


def listed_sets(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy(), column.value_lengths().to_numpy()


def exact_links(met: DataFrame, percent: int, sets_of=listed_sets) -> DataFrame:
    """``a, b``: links that connect the ids whose sets agree to ``percent``, within each meeting.

    ``met`` has the columns of ``meetings`` and ``set``: a full set, or what ``sets_of`` makes the
    sets of (the hashes of all rows one after another, and their numbers).
    """

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for group in groups(batches, 4):
            if group.num_rows < 2:
                continue
            held.append(group)
            size += group["set"].nbytes
            if size >= TOGETHER:
                yield of_groups(held)
                held, size = [], 0
        if held:
            yield of_groups(held)

    def of_groups(held: list[pa.Table]) -> pa.RecordBatch:
        table = pa.concat_tables(held)
        members = np.array([g.num_rows for g in held])
        values, sizes = sets_of(table["set"].combine_chunks())
        values = apart(values.astype(np.uint64), sizes, np.repeat(np.arange(len(held)), members))
        ids = table["id"].to_numpy()
        links, rest = side_by_side(values, sizes, members, percent)
        edges = list(zip(ids[links[:, 0]].tolist(), ids[links[:, 1]].tolist(), strict=True))
        if len(rest):
            ids, chosen = ids[rest].tolist(), np.zeros(len(sizes), bool)
            chosen[rest] = True
            linked = by_rarest(values[np.repeat(chosen, sizes)], sizes[rest], percent)
            edges += [(ids[x], ids[y]) for x, y in spanning(len(ids), linked)]
        return edge_batch(edges)

    keys = ["cluster", "g", "i", "j"]
    rows = met.select(*keys, "id", "set")
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lean(link), "a long, b long")

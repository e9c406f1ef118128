"""Small helpers shared by the operators: settled tables, Arrow batches, unions of links."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadsieve.sources.storage import checkpointed, scratch_path


#: Edges that one task joins at most.
TOGETHER = 200_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows whose ``column`` holds about ``limit`` bytes; at least one row each.

    What a task builds per run stays small, however many rows a batch has.
    """
    start = size = 0
    lengths = pa.compute.binary_length(batch.column(column)).to_pylist()
    for i, n in enumerate(lengths):
        if size and size + (n or 0) > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows with about a megabyte of ``text`` each."""
    for batch in batches:
        yield from slices(batch, "text")


def raw_texts(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def lowered(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8 with A-Z in lower case and nothing else changed; null is empty."""
    return [x.lower() for x in raw_texts(column)]


def give_back() -> None:
    """Return freed memory to the system: workers live on, and an executor has several."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


Body = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def lean(body: Body) -> Body:
    """The body of a ``mapInArrow`` that gives its memory back when a task ends, however it ends."""

    @wraps(body)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from body(batches)
        finally:
            give_back()

    return run


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder.

    A loop settles its states this way: a checkpoint keeps the partitioning and the
    constraints of the plan it cuts, and these grow with every turn.
    """
    path = scratch_path(df.sparkSession, "state")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, tables: list[DataFrame]) -> None:
    """Delete the files of written tables that nothing reads any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in {f.rsplit("/", 1)[0] for t in tables for f in t.inputFiles()}:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder.getParent(), True)


def components(edges: DataFrame, together: int = TOGETHER) -> DataFrame:
    """``id, component`` for every id in ``edges(a, b)``: the smallest id it is connected with.

    Tasks join at most ``together`` edges each by union-find, which leaves a forest of stars.
    If that took several tasks, every id hooks to its smallest neighbour (a minimum, combined
    before the shuffle), the hooks are followed to their roots, and the edges between
    different roots go to the next round. No neighbour list is ever collected. Each
    state is written to the shared folder; all but the result are deleted at the end.
    """
    states: list[DataFrame] = []

    def settled(df: DataFrame) -> DataFrame:
        states.append(written(df))
        return states[-1]

    live, labels = settled(_in_order(edges)), None
    while True:
        tasks = -(-live.count() // together)
        stars = live.repartition(max(1, tasks)).mapInArrow(lean(_stars), "id long, root long")
        if tasks > 1:
            live = settled(_in_order(stars.toDF("a", "b")))
            roots = _rooted(live, settled)
            to_a, to_b = (roots.toDF(name, f"root_{name}") for name in ("a", "b"))
            ends = live.join(to_a, "a").join(to_b, "b").select("root_a", "root_b").toDF("a", "b")
            live = settled(_in_order(ends))
        else:
            roots = settled(stars)
        if labels is None:
            labels = roots
        else:
            above = roots.toDF("root", "top")
            labels = settled(labels.join(above, "root", "left").select("id", F.coalesce("top", "root").alias("root")))
        if tasks <= 1:
            break
    result = written(labels.select("id", F.col("root").alias("component")))
    forget(edges.sparkSession, states)
    return result


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every id of a task's edges with the smallest id they connect it with."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    ids = list(parent)
    yield pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array([root(x) for x in ids], pa.int64())], names=["id", "root"]
    )


def _rooted(live: DataFrame, settled) -> DataFrame:
    """``id, root``: smallest neighbours, followed until they point at themselves."""
    both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
    hooks = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m"))
    roots = settled(hooks.select("id", F.least("id", "m").alias("root")))
    while True:
        up = roots.toDF("root", "top")
        moved = (F.col("top") < F.col("root")).alias("moved")
        jumped = settled(roots.join(up, "root").select("id", F.col("top").alias("root"), moved))
        if jumped.where("moved").isEmpty():
            return roots
        roots = jumped.select("id", "root")


def _in_order(ends: DataFrame) -> DataFrame:
    return ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


class Bits:
    """A bitmap of hashes with a fixed size, so it may be sent to every task.

    A hash that was added is always found; as more are added, more others are found
    too. It only spares work: what passes is joined exactly.
    """

    def __init__(self, hashes: DataFrame, bits: int = 1 << 23):
        """``hashes``: one column of non-negative longs."""
        slots = hashes.toDF("h").selectExpr(f"h % {bits} AS slot").where("slot IS NOT NULL")
        words = slots.groupBy(F.expr("slot >> 5").alias("w")).agg(
            F.expr("bit_or(shiftleft(1L, int(slot & 31)))").alias("b")
        )
        found = words.toArrow()  # at most bits / 32 rows
        packed = np.zeros(bits // 32, np.uint32)
        packed[found["w"].to_numpy()] = found["b"].to_numpy().astype(np.uint32)
        self.bits, self.packed = bits, packed

    def has(self, hashes: np.ndarray) -> np.ndarray:
        slot = hashes % np.uint64(self.bits)
        return (self.packed[slot >> np.uint64(5)] >> (slot & np.uint64(31)).astype(np.uint32)) & 1 == 1

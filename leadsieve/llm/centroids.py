"""Exact k-means with Shallot search over integer vectors.

Every vector remembers its nearest and its second-nearest centroid, an upper bound of the
distance to the first and a lower bound of the distance to all others. A round goes:

1. The bounds widen by how far the centroids moved. A vector whose upper bound stays below its lower bound,
   or below half the way from its centroid to the next one, keeps its centroid unseen.
2. The others measure the distance to both remembered centroids and start from the closer one. The
   remaining centroids are scanned in order of their distance from that one, as long as they
   lie in a ball around it whose radius is the distance to the vector plus that of the second-nearest
   centroid so far; the ball shrinks whenever a closer second is found.
3. What survives is compared by squared distances in 64-bit integers; equals go to the smaller number. Bounds
   are rounded outwards, so they never decide what integers would not.

The state of all vectors is a table in the shared folder, written once a round and deleted when the next one
is there. Sums move with the vectors: only those that change their centroid are read again, added up per task and
then over all tasks. The driver holds the centroids, their distances and sums, ``k`` times
``dimensions`` numbers; the same is all that tasks get.

Defined results: vectors that are null, have other than ``dimensions`` components, or a component that is
null, not finite or ``LARGEST`` or more in size (squared distances would leave 64 bits) are not
kept; with fewer than ``k`` vectors that have an id, there are that many centroids, with none there
are no rows; rows that repeat a ``vec_id`` are vectors of their own, started from in order of their components;
rows without ``vec_id`` start no centroid but belong to one; a centroid without vectors stays where it is; other
columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadsieve.llm.tables import forget, written

K, ROUNDS, DIMENSIONS, SCALE = 8, 10, 64, 1024

#: Components from here on are not kept.
LARGEST = 1 << 27

#: Rows that a task compares at a time.
STEP = 2048

#: Bounds are off by less than this part of themselves.
_UP, _DOWN = 1 + 1e-9, 1 - 1e-9

_STATE = "vec_id long, vector array<int>, cluster int, second int, upper double, lower double, before int"


def kept(embeddings: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """``vec_id, vector``: the usable vectors in integers."""
    x = F.transform("embedding", lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    finite = F.forall("embedding", lambda c: c.isNotNull() & (F.abs(c.cast("double")) * scale < LARGEST - 1))
    usable = F.col("embedding").isNotNull() & (F.size("embedding") == dimensions) & finite
    vector = F.when(usable, x.cast("array<int>"))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"))
    return rows.where("vector IS NOT NULL")


def first_centroids(vectors: DataFrame, k: int = K, seed: int = 3) -> np.ndarray:
    """The vectors whose seeded ids have the smallest SHA-256, in that order."""
    name = F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string"))
    first = vectors.where("vec_id IS NOT NULL").select(F.sha2(name, 256).alias("name"), "vector")
    return np.array([r.vector for r in first.orderBy("name", "vector").limit(k).collect()], np.int64)


class Centroids(NamedTuple):
    """Where the centroids are, how far each came, and how far they are from each other."""

    places: np.ndarray
    moved: np.ndarray
    #: the others of each centroid, nearest first, and lower bounds of the distances to them
    order: np.ndarray
    apart: np.ndarray


def centroids_at(places: np.ndarray, before: np.ndarray | None = None) -> Centroids:
    came = np.zeros(len(places)) if before is None else np.sqrt(squares(places - before)) * _UP
    apart = np.sqrt(np.array([squares(places - c) for c in places], float)) * _DOWN
    np.fill_diagonal(apart, -1.0)  # itself comes first and is left out
    order = np.argsort(apart, axis=1, kind="stable")[:, 1:]
    return Centroids(places, came, order, np.take_along_axis(apart, order, axis=1))


def squares(differences: np.ndarray) -> np.ndarray:
    return np.einsum("...i,...i->...", differences, differences)


class Nearest:
    """Squared distances of some vectors to their nearest and second-nearest centroids so far."""

    def __init__(self, vectors: np.ndarray, places: np.ndarray):
        self.vectors, self.places = vectors, places
        n = len(vectors)
        self.first = np.zeros(n, np.int64)
        self.second = np.full(n, -1, np.int64)
        self.first_square = np.full(n, np.iinfo(np.int64).max)
        self.second_square = np.full(n, np.iinfo(np.int64).max)

    def distances(self, rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        return squares(self.vectors[rows] - self.places[centroids])

    def see(self, rows: np.ndarray, centroids: np.ndarray) -> None:
        """Compare the vectors ``rows`` with one centroid each, not seen before."""
        square = self.distances(rows, centroids)
        old, old_square = self.first[rows], self.first_square[rows]
        wins = (square < old_square) | ((square == old_square) & (centroids < old))
        behind = ~wins & ((square < self.second_square[rows]) | (self.second[rows] < 0))
        self.second[rows] = np.where(wins, old, np.where(behind, centroids, self.second[rows]))
        self.second_square[rows] = np.where(wins, old_square, np.where(behind, square, self.second_square[rows]))
        self.first[rows] = np.where(wins, centroids, old)
        self.first_square[rows] = np.where(wins, square, old_square)


def shallot(vectors: np.ndarray, cluster: np.ndarray, second: np.ndarray, at: Centroids) -> Nearest:
    """Nearest and second-nearest centroids, searched from the closer of the two remembered ones."""
    every = np.arange(len(vectors))
    near = Nearest(vectors, at.places)
    near.first[:] = cluster
    near.first_square[:] = near.distances(every, cluster)
    if at.order.shape[1] == 0:
        return near
    known = second >= 0
    near.second_square[~known] = np.iinfo(np.int64).max
    near.see(every[known], second[known])
    start, reach = near.first.copy(), np.sqrt(near.first_square) * _UP
    alive = every
    for step in range(at.order.shape[1]):
        ball = reach[alive] + np.sqrt(near.second_square[alive]) * _UP
        alive = alive[at.apart[start[alive], step] <= ball]
        if not len(alive):
            break
        candidate = at.order[start[alive], step]
        fresh = (candidate != cluster[alive]) & (candidate != second[alive])
        near.see(alive[fresh], candidate[fresh])
    return near


def assigned(vectors: np.ndarray, state: tuple, at: Centroids, exact: bool) -> tuple:
    """``cluster, second, upper, lower`` of the next round; with ``exact`` squared distances as well."""
    cluster, second, upper, lower = (x.copy() for x in state)
    new = cluster < 0
    upper = np.where(new, np.inf, (upper + at.moved[np.maximum(cluster, 0)]) * _UP)
    lower = np.maximum(lower - at.moved.max(initial=0) * _UP, 0) * _DOWN
    alone = at.apart[:, 0] / 2 if at.apart.shape[1] else np.full(len(at.places), np.inf)
    safe = ~new & (upper < np.maximum(lower, alone[np.maximum(cluster, 0)]))
    cluster[new] = 0
    open_ = np.flatnonzero(~safe)
    tight = np.sqrt(squares(vectors[open_] - at.places[cluster[open_]])) * _UP
    upper[open_] = tight
    settled = ~new[open_] & (tight < np.maximum(lower[open_], alone[cluster[open_]]))
    open_ = open_[~settled]
    near = shallot(vectors[open_], cluster[open_], second[open_], at)
    cluster[open_], second[open_] = near.first, near.second
    upper[open_] = np.sqrt(near.first_square) * _UP
    lower[open_] = np.sqrt(near.second_square) * _DOWN
    distance = squares(vectors - at.places[cluster]) if exact else None
    return cluster, second, upper, lower, distance


def next_state(state: DataFrame, at: Centroids, exact: bool) -> DataFrame:
    """The state after one assignment; ``before`` is the centroid that a vector left, null if it stays."""
    dimensions = at.places.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, STEP):
                batch = whole.slice(start, STEP)
                vectors = batch.column("vector").flatten().to_numpy().astype(np.int64).reshape(-1, dimensions)
                old = tuple(batch.column(c).to_numpy() for c in ("cluster", "second", "upper", "lower"))
                cluster, second, upper, lower, distance = assigned(vectors, old, at, exact)
                arrays = [batch.column("vec_id"), batch.column("vector"), pa.array(cluster, pa.int32())]
                arrays += [pa.array(second, pa.int32()), pa.array(upper), pa.array(lower)]
                arrays.append(pa.array(old[0], pa.int32(), mask=cluster == old[0]))
                names = [*batch.schema.names[:6], "before"]
                if exact:
                    arrays, names = [*arrays, pa.array(distance)], [*names, "distance"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    columns = state.select("vec_id", "vector", "cluster", "second", "upper", "lower")
    return columns.mapInArrow(run, _STATE + (", distance long" if exact else ""))


def add_moves(state: DataFrame, sums: np.ndarray, counts: np.ndarray) -> None:
    """Move what the vectors that changed their centroid add to ``sums`` and ``counts``."""
    moved = state.where("before IS NOT NULL").select("before", "cluster", F.posexplode("vector").alias("i", "x"))
    totals = moved.groupBy("before", "cluster", "i").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    for r in totals.collect():  # at most (k + 1) * k * dimensions rows
        for c, sign in ((r.before, -1), (r.cluster, 1)):
            if c >= 0:
                sums[c, r.i] += sign * r.x
                counts[c] += sign * r.n if r.i == 0 else 0


def clustered(
    embeddings: DataFrame, k: int = K, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = 3
) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, vector, cluster, second, distance`` per kept vector, and the final centroids."""
    vectors = kept(embeddings, dimensions, scale)
    places = first_centroids(vectors, k, seed).reshape(-1, dimensions)
    if not len(places):
        empty = vectors.select("vec_id", "vector", *[F.lit(0).alias(c) for c in ("cluster", "second")])
        return empty.withColumn("distance", F.lit(0).cast("long")).limit(0), places
    none = [F.lit(-1).alias(c) for c in ("cluster", "second")] + [F.lit(0.0).alias(c) for c in ("upper", "lower")]
    state = vectors.select("vec_id", "vector", *none)
    sums, counts = np.zeros_like(places), np.zeros(len(places), np.int64)
    at = centroids_at(places)
    old: list[DataFrame] = []
    for _ in range(rounds):
        state = written(next_state(state, at, False))
        forget(embeddings.sparkSession, old)
        old = [state]
        add_moves(state, sums, counts)
        some = counts > 0
        after = at.places.copy()
        after[some] = sums[some] // counts[some, None]
        at = centroids_at(after, at.places)
    result = written(next_state(state, at, True))
    forget(embeddings.sparkSession, old)
    return result.select("vec_id", "vector", "cluster", "second", "distance"), at.places


def centroid_names(places: np.ndarray) -> list[str]:
    return [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in places]


def with_inertia(rows: DataFrame, places: np.ndarray) -> DataFrame:
    """Per vector ``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``."""
    spark = rows.sparkSession
    own = {r.cluster: r.s for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    names, total = centroid_names(places), sum(own.values())
    described = [(c, s, total, names[c]) for c, s in own.items()]
    schema = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    table = spark.createDataFrame(described, schema)
    return rows.select("vec_id", "cluster", "distance").join(F.broadcast(table), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )

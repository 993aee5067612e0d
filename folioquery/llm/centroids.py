"""Clustering around centroids, with a vantage-point tree over the centroids.

Vectors become integers, so that distances, means and ties are exact. Each round the driver builds a tree over the few
centroids and sends it to the tasks; a vector looks for its centroid best first: of the parts of the tree still open it
takes the one with the least possible distance, and it stops when that bound exceeds the best distance found. Bounds are
floating-point and kept a little too small, a part at exactly the best distance is still opened, and what decides is
integers: distance first, then the centroid's number. All vectors of a batch take their steps together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from folioquery.llm.common import written

LENGTH = 64
CLUSTERS = 40
ROUNDS = 5
SCALE = 256
LEAF = 4                 # centroids of a leaf
LARGEST = 2 ** 27        # integers up to here keep 64 squared differences below 2^63
FLOAT_EXACT = 2 ** 22    # and up to here below 2^53, where floating-point sums are exact
MARGIN = 1e-9            # bounds are lowered by this share
STEP_ROWS = 16_384


class VantageTree:
    """Nodes of a vantage-point tree; a node is a vantage point with two children, or a leaf with a few centroids.

    The arrays of a node: its centroids (``members``; the first one is the vantage point of an inner node), its
    children, and for each child the smallest and largest distance of its centroids to the vantage point.
    """

    def __init__(self, centroids: np.ndarray, leaf: int = LEAF):
        self.centroids = centroids
        self.members: list[np.ndarray] = []
        self.children: list[tuple[int, int] | None] = []
        self.rings: list[np.ndarray] = []
        self._grow(np.arange(len(centroids)), max(1, leaf))

    def _grow(self, these: np.ndarray, leaf: int) -> int:
        me = len(self.members)
        self.members.append(these)
        self.children.append(None)
        self.rings.append(np.zeros((2, 2)))
        if len(these) <= max(leaf, 2):
            return me
        points = self.centroids[these].astype(np.float64)
        # The centroid farthest from the middle sees the others at the most different distances.
        vantage = int(np.argmax(((points - points.mean(axis=0)) ** 2).sum(axis=1)))
        others = np.delete(np.arange(len(these)), vantage)
        away = np.sqrt(((points[others] - points[vantage]) ** 2).sum(axis=1))
        order = np.argsort(away, kind="stable")
        half = len(order) // 2
        self.members[me] = these[[vantage]]
        sides = [order[:half], order[half:]]
        self.rings[me] = np.array([[away[side[0]] * (1 - MARGIN), away[side[-1]] * (1 + MARGIN)] for side in sides])
        self.children[me] = tuple(self._grow(these[others[side]], leaf) for side in sides)
        return me


def squared(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Exact squared distances as 64-bit integers."""
    gap = rows - point
    return np.einsum("ij,ij->i", gap, gap).astype(np.int64)


def nearest_centroid(rows: np.ndarray, tree: VantageTree) -> tuple[np.ndarray, np.ndarray, int]:
    """(number, squared distance) of the nearest centroid of each row, ties to the smaller number, and how many
    distances were computed. All rows search best first at once, one step of each at a time."""
    exact_floats = max(np.abs(rows).max(initial=0), np.abs(tree.centroids).max(initial=0)) < FLOAT_EXACT
    dtype = np.float64 if exact_floats else np.int64
    rows, points = rows.astype(dtype), tree.centroids.astype(dtype)
    best = np.full(len(rows), np.iinfo(np.int64).max)
    number = np.full(len(rows), len(points))
    bound = np.full((len(rows), len(tree.members)), np.inf)
    bound[:, 0] = 0
    looking, computed = np.arange(len(rows)), 0
    while len(looking):
        node = bound[looking].argmin(axis=1)
        least = bound[looking, node]
        go = (least < np.inf) & (least <= np.sqrt(best[looking].astype(np.float64)) * (1 + MARGIN))
        looking, node, least = looking[go], node[go], least[go]
        for part in np.unique(node):
            who, floor = looking[node == part], least[node == part]
            bound[who, part] = np.inf
            away = None
            for c in tree.members[part].tolist():
                distance = squared(rows[who], points[c])
                computed += len(who)
                better = (distance < best[who]) | ((distance == best[who]) & (c < number[who]))
                best[who[better]], number[who[better]] = distance[better], c
                away = np.sqrt(distance.astype(np.float64)) if away is None else away
            if tree.children[part] is not None:
                for child, (low, high) in zip(tree.children[part], tree.rings[part]):
                    gap = np.maximum(away * (1 - MARGIN) - high, low - away * (1 + MARGIN))
                    bound[who, child] = np.maximum(np.maximum(gap, 0) * (1 - MARGIN), floor)
    return number, best, computed


def integer_vectors(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding",
                    length: int = LENGTH, scale: float = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component. Vectors of another length, null ones and those that hold a
    null or non-finite component take no part. A component beyond 2^27 after scaling raises an error, as its distances
    may not fit 64 bits."""
    def scaled(y: Column) -> Column:
        return F.lit(float(scale)) * y.cast("double")

    sound = (F.size("x") == length) & F.forall("x", lambda y: F.coalesce(F.abs(y.cast("double")) < F.lit(float("inf")), F.lit(False)))
    too_large = F.raise_error(F.lit("a component is too large for exact distances")).cast("long")
    return (vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).alias("x")).where(sound)
            .select("vec_id", F.transform("x", lambda y: F.when(F.abs(scaled(y)) <= LARGEST, F.floor(scaled(y)).cast("long"))
                                          .otherwise(too_large)).alias("v")))


def first_centroids(kept: DataFrame, clusters: int, salt: str) -> np.ndarray:
    """The vectors whose id hashes lowest, at most ``clusters`` rows; ties (repeated ids) by their components."""
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = kept.select(key.alias("key"), "v").orderBy("key", "v").limit(clusters).collect()
    return np.array([row.v for row in rows], dtype=np.int64)


def searched(kept: DataFrame, centroids: np.ndarray, leaf: int, finish, schema: str) -> DataFrame:
    """Look up the nearest centroid of every vector; ``finish(ids, rows, number, distance)`` yields batches of a task."""
    shared = kept.sparkSession.sparkContext.broadcast(VantageTree(centroids, leaf))  # clusters x length integers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for batch in batches:
                for start in range(0, batch.num_rows, STEP_ROWS):
                    part = batch.slice(start, STEP_ROWS)
                    lists = part.column("v")
                    rows = pc.list_flatten(lists).to_numpy().reshape(len(lists), -1)
                    number, distance, _ = nearest_centroid(rows, shared.value)
                    yield part.column("vec_id"), rows, number, distance

        yield from finish(found())

    return kept.mapInArrow(run, schema)


def means(kept: DataFrame, centroids: np.ndarray, leaf: int) -> np.ndarray:
    """Floors of the exact means of each centroid's vectors; a centroid without vectors stays.

    Each task sends one row of sums per centroid it met; their totals, a row per centroid and component, reach the driver.
    """
    def sums(found) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(centroids), dtype=np.int64), np.zeros(centroids.shape, dtype=np.int64)
        for _, rows, number, _ in found:
            np.add.at(total, number, rows)
            count += np.bincount(number, minlength=len(count))
        met = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(count[met], pa.int64()),
                                          pa.array(list(total[met]), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    parts = searched(kept, centroids, leaf, sums, "cluster int, n long, total array<long>")
    rows = (parts.select("cluster", "n", F.posexplode("total").alias("at", "total")).groupBy("cluster", "at")
            .agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect())
    out = centroids.copy()
    for row in rows:
        out[row["cluster"], row["at"]] = int(row["total"]) // row["n"]
    return out


def clustered(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, salt: str = "2", leaf: int = LEAF,
              **columns) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: one row per vector that takes part.

    ``columns`` go to ``integer_vectors``, which says what takes part. The first centroids are the ``clusters`` vectors
    (all, if fewer) whose ``salt:vec_id`` hashes lowest, in that order; a null id hashes as an empty one. Each round
    assigns every vector to the nearest centroid - squared Euclidean distance, ties to the smaller number - and moves
    the centroids to the floors of the means; the vectors are then assigned once more. Rows that repeat a vec_id are
    vectors of their own. An empty table gives an empty result.
    """
    kept = written(integer_vectors(vectors, **columns))
    centroids = first_centroids(kept, clusters, salt)
    schema = "vec_id long, cluster int, distance long"
    if not len(centroids):
        return kept.sparkSession.createDataFrame([], schema + ", cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = means(kept, centroids, leaf)

    def assignments(found) -> Iterator[pa.RecordBatch]:
        for ids, _, number, distance in found:
            yield pa.RecordBatch.from_arrays([ids, pa.array(number, pa.int32()), pa.array(distance, pa.int64())],
                                             ["vec_id", "cluster", "distance"])

    assigned = written(searched(kept, centroids, leaf, assignments, schema))
    inertia = {row["cluster"]: row["inertia"] for row in
               assigned.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    about = [(c, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest())
             for c in sorted(inertia)]  # a row per centroid
    about = kept.sparkSession.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(about), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

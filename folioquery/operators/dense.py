"""Dense vectors: exact top-k search by blocks, and the same search over pruned cells."""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from folioquery import constants as K
from folioquery.session import checkpoint, shuffle_width

PACK_ROWS = 1024
SLICES = 8  # partitions of chunks that a question meets, each with k best of its own


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Unit rows in double precision."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(vectors), -1)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _one_list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _packs(df: DataFrame, key: str, width: int, size: int | None = None) -> DataFrame:
    """(cell, key, category, vector, ...) rows -> rows of up to ``size`` unit vectors, written down once.

    Rows are dealt out in ranges of (cell, key), so that a pack holds neighbouring cells and a cell with a third of all
    vectors still falls into several partitions. ``low`` and ``high`` are the ends of the cells of a pack; a row without
    a cell looks into all of them. A column ``probes`` goes along.
    """
    size, extra = size or PACK_ROWS, [c for c in ("probes",) if c in df.columns]
    rows = (df.where(F.exists("vector", lambda x: x != 0))
            .select("cell", F.col(key).alias("key"), F.col("category").cast("string").alias("category"), "vector", *extra))
    key_type = rows.schema["key"].dataType

    def packed(part: pa.RecordBatch) -> pa.RecordBatch:
        cells = part.column("cell")
        lowest, highest = (0, 2**31 - 1) if cells.null_count else (pc.min(cells).as_py(), pc.max(cells).as_py())
        return pa.RecordBatch.from_pydict({
            "low": pa.array([lowest], pa.int32()), "high": pa.array([highest], pa.int32()), "cells": _one_list(cells),
            "keys": _one_list(part.column("key")), "categories": _one_list(part.column("category")),
            "matrix": pa.array([_matrix(part.column("vector")).tobytes()], pa.binary()),
            **{c: pa.array([b"".join(part.column(c).to_pylist())], pa.binary()) for c in extra}})

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                yield packed(batch.slice(at, min(size, batch.num_rows - at)))

    packs = rows.repartitionByRange(width, "cell", "key").sortWithinPartitions("cell", "key").mapInArrow(pack, T.StructType([
        T.StructField("low", T.IntegerType()), T.StructField("high", T.IntegerType()),
        T.StructField("cells", T.ArrayType(T.IntegerType())), T.StructField("keys", T.ArrayType(key_type)),
        T.StructField("categories", T.ArrayType(T.StringType())), T.StructField("matrix", T.BinaryType()),
        *[T.StructField(c, T.BinaryType()) for c in extra]]))
    return checkpoint(packs.withColumn("pack", F.monotonically_increasing_id()))


class _Best:
    """The k best chunks so far of each question of a pack, in units of the last score digit."""

    def __init__(self, asked: pa.Array, k: int, threshold: float, relevance: bool, repeats: bool):
        self.asked, self.k, self.threshold, self.relevance, self.repeats = asked, k, threshold, relevance, repeats
        self.bound = np.full(len(asked), threshold * 10 ** K.SCORE_DIGITS - 1)
        self.found, self.waiting = [], 0

    def look(self, who: np.ndarray, asks: np.ndarray, chunks: np.ndarray, keys: pa.Array, allowed: np.ndarray | None) -> None:
        """Score some questions against chunks in key order; only what can still be among the k best is kept."""
        scale, width = 10 ** K.SCORE_DIGITS, len(chunks)
        cosines = asks @ chunks.T
        least = (self.bound[who] - 1) / scale
        if self.relevance:
            least = 1.0 - (1.0 - least) * math.sqrt(2.0) / 2.0
        keep = cosines >= least[:, None]
        if allowed is not None:
            keep &= allowed
        rows, cols = np.nonzero(keep)
        if len(rows) > len(who) * self.k:  # far more than can be needed: the k best of this block per question
            hot = np.unique(rows)
            part = self._units(cosines[hot])
            ranked = np.where(keep[hot], part * width + (width - 1 - np.arange(width)), -np.inf)
            if self.k < width:
                picks = np.argpartition(ranked, width - self.k, axis=1)[:, width - self.k:]
            else:
                picks = np.broadcast_to(np.arange(width), ranked.shape)
            rows, cols = np.repeat(hot, picks.shape[1]), picks.ravel()
            inside = keep[rows, cols]
            rows, cols = rows[inside], cols[inside]
        units = self._units(cosines[rows, cols])
        good = (units >= self.bound[who[rows]]) & (units / scale >= self.threshold)
        if good.any():
            self.found.append((who[rows[good]], units[good], keys.take(pa.array(cols[good]))))
            self.waiting += int(good.sum())
            if self.waiting > 2 * self.k * len(self.asked):
                self.settle()

    def _units(self, cosines: np.ndarray) -> np.ndarray:
        values = 1.0 - (2.0 - 2.0 * cosines) / math.sqrt(2.0) if self.relevance else cosines
        return np.rint(values * 10 ** K.SCORE_DIGITS)

    def settle(self) -> None:
        if not self.found:
            return
        rows, units, keys = (list(c) for c in zip(*self.found))
        all_ = pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(rows)), pa.array(-np.concatenate(units)), pa.concat_arrays(keys)], names=["row", "units", "key"])
        if self.repeats:  # a pair may have met in several cells
            all_ = self._sorted(all_, ["row", "key", "units"])
            keys, rows = all_.column("key"), all_.column("row").to_numpy()
            same = pc.fill_null(pc.equal(keys[1:], keys[:-1]), False).to_numpy(zero_copy_only=False)
            same |= (keys[1:].is_null().to_numpy(zero_copy_only=False)) & (keys[:-1].is_null().to_numpy(zero_copy_only=False))
            fresh = np.append(True, ~same | (rows[1:] != rows[:-1]))
            all_ = all_.filter(pa.array(fresh))
        all_ = self._sorted(all_, ["row", "units", "key"])
        rows = all_.column("row").to_numpy()
        starts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        place = np.arange(len(rows)) - np.repeat(starts, np.diff(np.append(starts, len(rows))))
        all_, last = all_.filter(pa.array(place < self.k)), place == self.k - 1
        self.bound[rows[last]] = np.maximum(self.bound[rows[last]], -all_.filter(pa.array(place[place < self.k] == self.k - 1)).column("units").to_numpy())
        self.found, self.waiting = [(all_.column("row").to_numpy(), -all_.column("units").to_numpy(), all_.column("key"))], 0

    @staticmethod
    def _sorted(batch: pa.RecordBatch, by: list[str]) -> pa.RecordBatch:
        return batch.take(pc.sort_indices(batch, sort_keys=[(c, "ascending") for c in by], null_placement="at_start"))

    def rows(self) -> Iterator[pa.RecordBatch]:
        self.settle()
        for rows, units, keys in self.found:
            yield pa.RecordBatch.from_pydict({
                "question_id": self.asked.take(pa.array(rows)), "key": keys, "score": pa.array(units / 10 ** K.SCORE_DIGITS, pa.float64())})


def _score_packs(ask_packs: DataFrame, chunk_packs: DataFrame, k: int, threshold: float, metric: str, cells: int | None = None,
                 repeats: bool = False) -> DataFrame:
    """Every pack of questions against the packs of chunks whose cells it looks into, and the k best per question.

    A task takes one partition of each side, as written by ``_packs``: packs are read again by several tasks, but neither
    moved nor copied for each other. It sees two packs at a time and keeps the k best per question over its whole
    partition, so that a question gives at most k rows per partition of chunks. With ``cells`` a question has one bit per
    cell that it looks into (``probes``); a pair may then meet in several cells, if ``repeats``.
    """
    if metric not in ("cosine", "l2_relevance"):
        raise ValueError(f"unknown metric {metric}")
    relevance, probing = metric == "l2_relevance", cells is not None
    left = ask_packs.select(*[F.col(c).alias(f"a_{c}") for c in ask_packs.columns])
    ask_type, key_type = (packs.schema["keys"].dataType.elementType for packs in (ask_packs, chunk_packs))
    meet = F.lit(True) if probing else (F.col("a_low") <= F.col("high")) & (F.col("a_high") >= F.col("low"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, current, asks, wanted, bits = None, None, None, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda name: batch.column(name)[i]  # noqa: B023, E731
                if best is None or get("a_pack").as_py() != current:
                    if best is not None:
                        yield from best.rows()
                    current, asked, wanted = get("a_pack").as_py(), get("a_keys").values, get("a_categories").values
                    asks = np.frombuffer(get("a_matrix").as_buffer()).reshape(len(asked), -1).copy()
                    best = _Best(asked, k, threshold, relevance, repeats)
                    if probing:
                        bits = np.frombuffer(get("a_probes").as_buffer(), np.uint8).reshape(len(asked), -1).copy()
                keys, given, cell = get("keys").values, get("categories").values, get("cells").values.to_numpy(zero_copy_only=False)
                chunks = np.frombuffer(get("matrix").as_buffer()).reshape(len(keys), -1)
                allowed = _same_category(wanted, given) if wanted.null_count < len(wanted) else None
                if not probing:
                    order = pc.sort_indices(keys, null_placement="at_start").to_numpy()
                    best.look(np.arange(len(asks)), asks, chunks[order], keys.take(pa.array(order)),
                              None if allowed is None else allowed[:, order])
                    continue
                starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
                for a, b in zip(starts, np.append(starts[1:], len(cell))):
                    who = np.flatnonzero(bits[:, cell[a] >> 3] >> (cell[a] & 7) & 1)
                    if len(who):
                        best.look(who, asks[who], chunks[a:b], keys.slice(a, b - a), None if allowed is None else allowed[who, a:b])
        if best is not None:
            yield from best.rows()

    # Sides are estimated from few statistics: without the hint one may be taken for small and sent through the driver.
    found = left.join(chunk_packs.hint("shuffle_replicate_nl"), meet).mapInArrow(search, T.StructType([
        T.StructField("question_id", ask_type), T.StructField("key", key_type),
        T.StructField("score", T.DoubleType())]))
    best_first = W.partitionBy("question_id").orderBy(F.desc("score"), "key")
    if repeats:
        found = found.groupBy("question_id", "key").agg(F.max("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)


def _same_category(wanted: pa.Array, given: pa.Array) -> np.ndarray:
    """Which question may see which chunk; names are compared by their numbers in one dictionary."""
    codes = pa.concat_arrays([wanted, given]).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    ours, theirs = codes[:len(wanted)], codes[len(wanted):]
    return (ours < 0)[:, None] | (ours[:, None] == theirs[None, :])


def _widths(spark: SparkSession) -> tuple[int, int]:
    """Partitions of questions and of chunks: as many tasks as the session's shuffles have. A question gives k rows per
    partition of chunks, so there are few of them."""
    width = shuffle_width(spark)
    chunks = min(SLICES, width)
    return -(-width // chunks), chunks


def dense_topk(questions: DataFrame, chunks: DataFrame, key: str = "chunk_key", k: int = K.TOP_K,
               threshold: float = -1.0, metric: str = "cosine") -> DataFrame:
    """Exact best k chunks per question: (question_id, rank, score, key).

    questions: (question_id, vector, category), category empty or NULL for all; chunks: (key, category,
    vector). Vectors of length zero match nothing. A category is a cell, so a question that names one meets the
    vectors of that category only.
    """
    ask_parts, chunk_parts = _widths(chunks.sparkSession)
    asks = _by_category(_filters(questions)).withColumn("cell", F.when(F.col("category").isNotNull(), F.col("cell")))
    hits = _score_packs(_packs(asks, "question_id", ask_parts), _packs(_by_category(chunks), key, chunk_parts),
                        k, threshold, metric)
    return hits.select("question_id", "rank", "score", F.col("key").alias(key))


def _filters(questions: DataFrame) -> DataFrame:
    return questions.withColumn("category", F.nullif(F.col("category").cast("string"), F.lit("")))


def _by_category(df: DataFrame) -> DataFrame:
    """Cell by category; two categories may share one, so scoring still compares their names."""
    name = F.coalesce(F.col("category").cast("string"), F.lit(""))
    return df.withColumn("cell", F.xxhash64(name).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))


def train_cells(chunks: DataFrame, cells: int = 32, seed: int = 7) -> np.ndarray:
    """Unit cell centres from k-means; ``cells`` bounds what is shipped to the tasks."""
    points = chunks.where(F.exists("vector", lambda x: x != 0)).select(array_to_vector("vector").alias("features"))
    model = KMeans(k=cells, seed=seed, maxIter=5, distanceMeasure="cosine").fit(points)
    centres = np.array(model.clusterCenters())
    return centres / np.linalg.norm(centres, axis=1, keepdims=True)


def assign_cells(chunks: DataFrame, centres: np.ndarray) -> DataFrame:
    """Add the nearest ``cell`` and the cosine ``fit`` to its centre."""
    schema = T.StructType([*chunks.schema.fields, T.StructField("cell", T.IntegerType()),
                           T.StructField("fit", T.DoubleType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = _matrix(batch.column("vector")) @ centres.T
                cell = near.argmax(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(cell, pa.int32()), pa.array(near.max(axis=1))],
                    names=[*batch.schema.names, "cell", "fit"])

    return chunks.where(F.exists("vector", lambda x: x != 0)).mapInArrow(assign, schema)


def probe_cells(questions: DataFrame, centres: np.ndarray, reach: dict[int, float], cosine: float,
                probes: int | None = None) -> DataFrame:
    """Add ``probes``: one bit for every cell that can hold a chunk with at least this cosine.

    ``reach`` has for each cell the smallest ``fit`` of its members, that is its widest angle. A
    chunk within the wanted angle of the question lies in a cell whose centre is no further away than the
    wanted plus the widest angle, so skipping all other cells loses nothing. ``probes`` trades recall for
    time as an approximate index does: only that many nearest cells are looked at.
    """
    schema = T.StructType([*questions.schema.fields, T.StructField("probes", T.BinaryType())])
    count = min(probes or len(centres), len(centres))
    wanted = math.acos(min(1.0, max(-1.0, cosine))) + 1e-6
    widest = np.array([wanted + math.acos(max(-1.0, min(1.0, reach[c]))) if c in reach else -1.0 for c in range(len(centres))])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = np.clip(_matrix(batch.column("vector")) @ centres.T, -1.0, 1.0)
                open_ = np.arccos(near) <= widest
                if count < len(centres):
                    nearest = np.zeros_like(open_)
                    np.put_along_axis(nearest, np.argsort(-near, axis=1)[:, :count], True, axis=1)
                    open_ &= nearest
                yield pa.RecordBatch.from_arrays([*batch.columns, cell_bits(open_)], names=[*batch.schema.names, "probes"])

    return questions.where(F.exists("vector", lambda x: x != 0)).mapInArrow(probe, schema)


def cell_bits(open_: np.ndarray) -> pa.Array:
    """Rows of flags as bytes of eight flags, the first one lowest."""
    return pa.array([row.tobytes() for row in np.packbits(open_, axis=1, bitorder="little")], pa.binary())


def cell_topk(questions: DataFrame, chunks: DataFrame, centres: np.ndarray, threshold: float,
              key: str = "chunk_key", k: int = K.TOP_K, probes: int | None = None) -> DataFrame:
    """Top-k by cosine over cells instead of all vectors; exact unless ``probes`` is given."""
    ask_parts, chunk_parts = _widths(chunks.sparkSession)
    placed = assign_cells(chunks.select(key, "category", "vector"), centres)
    # One row per cell: bounded by the number of centres.
    reach = {r.cell: r.min_fit for r in placed.groupBy("cell").agg(F.min("fit").alias("min_fit")).collect()}
    asks = probe_cells(_filters(questions).select("question_id", "category", "vector"), centres, reach,
                       threshold - 10.0 ** -K.SCORE_DIGITS, probes)
    hits = _score_packs(_packs(asks.withColumn("cell", F.lit(0)), "question_id", ask_parts),
                        _packs(placed, key, chunk_parts), k, threshold, "cosine", cells=len(centres))
    return hits.select("question_id", "rank", "score", F.col("key").alias(key))

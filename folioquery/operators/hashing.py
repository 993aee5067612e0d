"""Approximate nearest vectors by random projections.

A table hashes a vector to the signs of a few projections; the tables together use directions of random rotations. A
chunk lies in one bucket of each table. A question looks into the buckets it is most likely to share with a near chunk:
of all signs those that cost the least, where turning round the sign of a projection costs its square. Chunks lie in the
order of their buckets and are scored in slices; a question has one bit per bucket and is not repeated for each.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from folioquery import constants as K
from folioquery.operators.dense import _filters, _matrix, _packs, _score_packs, _widths, cell_bits

TABLES, BITS, PROBES = 8, 8, 24
SLICE_ROWS = 4_096      # chunks of neighbouring buckets that are scored at a time


def projections(length: int, tables: int = TABLES, bits: int = BITS, seed: int = 11) -> np.ndarray:
    """(tables, bits, length) unit directions, orthogonal within each group of ``length`` of them."""
    random, rows = np.random.default_rng(seed), np.zeros((0, length))
    while len(rows) < tables * bits:
        rows = np.concatenate([rows, np.linalg.qr(random.normal(size=(length, length)))[0]])
    return rows[:tables * bits].reshape(tables, bits, length)


def bucket_codes(vectors: np.ndarray, planes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, tables) codes and (rows, tables, bits) projections of unit vectors."""
    sides = np.einsum("nd,tbd->ntb", vectors, planes)
    return (sides > 0) @ (1 << np.arange(planes.shape[1])), sides


def probed_codes(vectors: np.ndarray, planes: np.ndarray, probes: int) -> np.ndarray:
    """(rows, tables, probes) codes, the cheapest ones first; ties go to the smaller change."""
    codes, sides = bucket_codes(vectors, planes)
    changes = np.arange(1 << planes.shape[1])
    turned = (changes[:, None] >> np.arange(planes.shape[1])) & 1
    cost = np.einsum("ntb,cb->ntc", sides ** 2, turned.astype(float))
    return codes[:, :, None] ^ np.argsort(cost, axis=2, kind="stable")[:, :, :probes]


def _placed(df: DataFrame, planes: np.ndarray) -> DataFrame:
    """Repeat each row for its bucket in every table; ``cell`` numbers the bucket."""
    schema = T.StructType([*df.schema.fields, T.StructField("cell", T.IntegerType())])
    first = np.arange(len(planes)) << planes.shape[1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                cells = first + bucket_codes(_matrix(part.column("vector")), planes)[0]
                repeated = part.take(pa.array(np.repeat(np.arange(part.num_rows), len(planes))))
                yield pa.RecordBatch.from_arrays([*repeated.columns, pa.array(cells.ravel(), pa.int32())],
                                                 names=[*part.schema.names, "cell"])

    return df.where(F.exists("vector", lambda x: x != 0)).mapInArrow(place, schema)


def _probing(df: DataFrame, planes: np.ndarray, probes: int) -> DataFrame:
    """Add ``probes``, one bit per bucket that a question looks into; the question itself is not repeated."""
    schema = T.StructType([*df.schema.fields, T.StructField("probes", T.BinaryType())])
    first = np.arange(len(planes))[:, None] << planes.shape[1]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                cells = (first + probed_codes(_matrix(part.column("vector")), planes, probes)).reshape(part.num_rows, -1)
                open_ = np.zeros((part.num_rows, len(planes) << planes.shape[1]), dtype=bool)
                np.put_along_axis(open_, cells, True, axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, cell_bits(open_)], names=[*part.schema.names, "probes"])

    return df.where(F.exists("vector", lambda x: x != 0)).mapInArrow(probe, schema)


def hashed_topk(questions: DataFrame, chunks: DataFrame, planes: np.ndarray, threshold: float = -1.0, key: str = "chunk_key",
                k: int = K.TOP_K, probes: int = PROBES) -> DataFrame:
    """The k best chunks by cosine among those that share a probed bucket: (question_id, rank, score, key).

    questions: (question_id, vector, category), category empty or NULL for all; chunks: (key, category, vector). Vectors of
    length zero match nothing. More probes or tables find more and look at more: with 8 tables of 8 bits and 24 probes a
    question meets about half of vectors without any structure, and fewer the nearer its best chunks are.
    """
    ask_parts, chunk_parts = _widths(chunks.sparkSession)
    asks = _probing(_filters(questions).select("question_id", "category", "vector"), planes, probes)
    hits = _score_packs(_packs(asks.withColumn("cell", F.lit(0)), "question_id", ask_parts),
                        _packs(_placed(chunks.select(key, "category", "vector"), planes), key, chunk_parts, SLICE_ROWS),
                        k, threshold, "cosine", cells=len(planes) << planes.shape[1], repeats=True)
    return hits.select("question_id", "rank", "score", F.col("key").alias(key))

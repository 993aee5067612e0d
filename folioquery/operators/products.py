"""All products of sparse unit vectors, block by block: the pairs that can be among the k best of a question.

Where many questions meet frequent words, summing one row per question, vector and shared term costs far more than the
products themselves. Here questions and vectors are written down once as packs (a few thousand rows, their words numbered
within the pack) and a task takes one partition of packs of each side. Of two packs that meet, terms that make many pairs
are multiplied as dense single precision blocks, all others pair by pair. Only what can still be among the k best of its
question over the whole partition is kept, with a margin for rounding; exact scores are made later, for these pairs only.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from folioquery import constants as K
from folioquery.session import written

ASK_ROWS, VECTOR_ROWS = 2048, 4096
DENSE = 0.0003          # share of all pairs of two packs from which a term is multiplied as a dense block
DENSE_TERMS = 2048      # terms of a dense block
SPARSE_PAIRS = 1 << 22  # pairs that are added at a time
EPS = 2.0 ** -23

_PACKS = T.StructType([
    T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("categories", T.ArrayType(T.StringType())),
    T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("sizes", T.BinaryType()),
    T.StructField("rows", T.BinaryType()), T.StructField("values", T.BinaryType())])
_KINDS = {"sizes": np.int32, "rows": np.int32, "values": np.float32}


def _one_list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _packs(df: DataFrame, key: str, category: str, words: Column, size: int) -> DataFrame:
    """Rows with ``words`` (array of (term, value)) -> packs of up to ``size`` rows, made where the rows lie: for each term
    of ``terms``, ``sizes`` has the number of rows with it, and ``rows`` and ``values`` have these one after the other."""
    def packed(part: pa.RecordBatch) -> pa.RecordBatch:
        said = part.column("words")
        flat, lengths = said.flatten(), pc.list_value_length(said).to_numpy(zero_copy_only=False)
        coded = pc.struct_field(flat, 0).dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(codes, kind="stable")
        held = {
            "sizes": np.bincount(codes, minlength=len(coded.dictionary)).astype(np.int32),
            "rows": np.repeat(np.arange(len(said), dtype=np.int32), lengths)[order],
            "values": pc.struct_field(flat, 1).to_numpy(zero_copy_only=False).astype(np.float32)[order]}
        return pa.RecordBatch.from_pydict({
            "keys": _one_list(part.column("key")), "categories": _one_list(part.column("category")),
            "terms": _one_list(coded.dictionary), **{n: pa.array([x.tobytes()], pa.binary()) for n, x in held.items()}})

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                yield packed(batch.slice(at, min(size, batch.num_rows - at)))

    rows = df.where(F.size(words) > 0).select(F.col(key).alias("key"), F.col(category).alias("category"), words.alias("words"))
    return rows.mapInArrow(pack, _PACKS).withColumn("pack", F.monotonically_increasing_id())


def _weighted_packs(packs: DataFrame, total: DataFrame, stats: DataFrame) -> DataFrame:
    """Add the factors of terms and rows that make unit vectors of raw counts. Frequencies are joined once for each term of
    a pack, not for each posting."""
    known = (packs.select("pack", F.posexplode("terms").alias("at", "term")).join(stats, "term")
             .groupBy("pack").agg(F.collect_list(F.struct("at", "df")).alias("known")))  # the terms of one pack
    n = total.first().n

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                sizes, rows, values = (_array(one, c, 0, kind) for c, kind in _KINDS.items())
                df, found = np.zeros(len(sizes)), one.column("known").flatten()
                df[pc.struct_field(found, 0).to_numpy(zero_copy_only=False)] = pc.struct_field(found, 1).to_numpy(zero_copy_only=False)
                idf = np.log((1 + n) / (1 + df)) + 1
                weights = values * np.repeat(idf, sizes)
                made = {"by_term": idf, "by_row": 1 / np.sqrt(np.bincount(rows, weights * weights))}
                yield pa.RecordBatch.from_arrays(
                    [*[one.column(c) for c in names], *[pa.array([x.astype(np.float32).tobytes()], pa.binary()) for x in made.values()]],
                    [*names, *made])

    names = [*_PACKS.names, "pack"]
    factors = [T.StructField(c, T.BinaryType()) for c in ("by_term", "by_row")]
    return packs.join(known, "pack").mapInArrow(weigh, T.StructType([*_PACKS.fields, T.StructField("pack", T.LongType()), *factors]))


def _array(batch: pa.RecordBatch, name: str, at: int, kind: type) -> np.ndarray:
    return np.frombuffer(batch.column(name)[at].as_buffer(), kind)


class _Pack:
    def __init__(self, pair: pa.RecordBatch, side: str, at: int):
        self.keys, self.categories = (pair.column(side + c)[at].values for c in ("keys", "categories"))
        self.terms = pair.column(side + "terms")[at].values
        self.sizes, self.rows, self.values = (_array(pair, side + c, at, kind) for c, kind in _KINDS.items())
        if not side:  # counts, each term and each row with a factor
            by_term, by_row = (_array(pair, c, at, np.float32) for c in ("by_term", "by_row"))
            self.values = self.values * np.repeat(by_term, self.sizes) * by_row[self.rows]
        self.starts = np.cumsum(self.sizes, dtype=np.int64) - self.sizes


def _products(asks: _Pack, vectors: _Pack) -> np.ndarray:
    """All products of two packs in single precision."""
    n_asks, n_vectors = len(asks.keys), len(vectors.keys)
    out = np.zeros((n_asks, n_vectors), np.float32)
    place = pc.fill_null(pc.index_in(asks.terms, value_set=vectors.terms), -1).to_numpy(zero_copy_only=False)
    there = np.where(place >= 0, vectors.sizes[place], 0).astype(np.int64)  # rows of vectors with a term of the questions
    pairs = there * asks.sizes
    dense = pairs > DENSE * n_asks * n_vectors
    chosen = np.flatnonzero(dense)
    for at in range(0, len(chosen), DENSE_TERMS):
        terms = chosen[at:at + DENSE_TERMS]
        left, right = (np.zeros((n, len(terms)), np.float32) for n in (n_asks, n_vectors))
        for matrix, pack, codes in ((left, asks, terms), (right, vectors, place[terms])):
            postings = _ranges(pack.starts[codes], pack.sizes[codes])
            matrix[pack.rows[postings], np.repeat(np.arange(len(codes)), pack.sizes[codes])] = pack.values[postings]
        out += left @ right.T
    rest = np.flatnonzero(~dense & (pairs > 0))
    postings = _ranges(asks.starts[rest], asks.sizes[rest])  # of the questions, each with some rows of vectors
    first, many = (np.repeat(x, asks.sizes[rest]) for x in (vectors.starts[place[rest]], there[rest]))
    flat, ends = out.reshape(-1), np.cumsum(many)
    at = 0
    while at < len(postings):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SPARSE_PAIRS)))
        theirs = _ranges(first[at:to], many[at:to])
        ours = np.repeat(postings[at:to], many[at:to])
        np.add.at(flat, asks.rows[ours].astype(np.int64) * n_vectors + vectors.rows[theirs], asks.values[ours] * vectors.values[theirs])
        at = to
    return out


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, one range after the other."""
    sizes = sizes.astype(np.int64)
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class _Best:
    """What can be among the k best of each question of a pack, as far as it was looked at."""

    def __init__(self, asks: _Pack, k: int, floor: float):
        self.asks, self.k = asks, k
        # Sums of products in single precision, of scores of one at most, and rounded scores on both sides.
        self.slack = 2 * 10.0 ** -K.SCORE_DIGITS + 2 * EPS * (np.bincount(asks.rows, minlength=len(asks.keys)) + 8)
        self.bound = np.maximum(floor - self.slack, 1e-30).astype(np.float32)  # above zero: some term is shared
        self.found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)]

    def look(self, vectors: _Pack) -> None:
        scores = _products(self.asks, vectors)
        wanted = self.asks.categories
        if pc.any(pc.not_equal(wanted, "")).as_py():
            codes = pa.concat_arrays([wanted, vectors.categories]).dictionary_encode().indices.to_numpy(zero_copy_only=False)
            every = pc.equal(wanted, "").to_numpy(zero_copy_only=False)
            scores[~every[:, None] & (codes[:len(wanted), None] != codes[None, len(wanted):])] = 0
        keep = scores >= self.bound[:, None]
        if scores.shape[1] > self.k and np.count_nonzero(keep) > 2 * self.k * len(self.bound):
            self._raise(np.partition(scores, -self.k, axis=1)[:, -self.k])
            keep = scores >= self.bound[:, None]
        rows, cols = np.nonzero(keep)
        new = (rows, vectors.keys.to_numpy(zero_copy_only=False)[cols], scores[rows, cols])
        rows, keys, values = (np.concatenate(x) for x in zip(self.found, new))
        order = np.lexsort((-values, rows))
        rows, keys, values = rows[order], keys[order], values[order]
        last = np.flatnonzero(np.arange(len(rows)) - np.searchsorted(rows, rows) == self.k - 1)
        best = np.zeros(len(self.bound), np.float32)
        best[rows[last]] = values[last]
        self._raise(best)
        keep = values >= self.bound[rows]
        self.found = [rows[keep], keys[keep], values[keep]]

    def _raise(self, best: np.ndarray) -> None:
        self.bound = np.maximum(self.bound, (best - self.slack).astype(np.float32))

    def rows(self) -> pa.RecordBatch:
        rows, keys, values = self.found
        return pa.RecordBatch.from_pydict({
            "asking": self.asks.keys.take(pa.array(rows)), "vector": pa.array(keys), "near": pa.array(values.astype(np.float64)),
            "slack": pa.array(self.slack[rows])})


def best_pairs(asks: DataFrame, vectors: DataFrame, total: DataFrame, stats: DataFrame, k: int, floor: float) -> DataFrame:
    """(asking, vector) of all pairs that share a term, reach ``floor`` and are among the k best of their question, or so
    near to these that only exact scores tell.

    asks: (asking, only, terms, weights), unit vectors; vectors: (vector, category, counts)."""
    left = written(_packs(asks, "asking", "only", F.arrays_zip("terms", "weights"), ASK_ROWS), maxRecordsPerFile=1)
    raw = written(_packs(vectors, "vector", "category", F.col("counts"), VECTOR_ROWS))
    right = written(_weighted_packs(raw, total, stats), maxRecordsPerFile=4)
    left = left.select(*[F.col(c).alias(f"a_{c}") for c in left.columns])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, current = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                if best is None or batch.column("a_pack")[i].as_py() != current:
                    if best is not None:
                        yield best.rows()
                    current = batch.column("a_pack")[i].as_py()
                    best = _Best(_Pack(batch, "a_", i), k, floor)
                best.look(_Pack(batch, "", i))
        if best is not None:
            yield best.rows()

    # Without the hint a side may be taken for small and sent through the driver.
    found = left.join(right.hint("shuffle_replicate_nl"), F.lit(True)).mapInArrow(search, T.StructType([
        T.StructField("asking", T.LongType()), T.StructField("vector", T.LongType()), T.StructField("near", T.DoubleType()),
        T.StructField("slack", T.DoubleType())]))
    per_ask = W.partitionBy("asking")  # a few rows of each partition of vectors
    last = F.max(F.when(F.col("n") == k, F.col("near"))).over(per_ask)
    return (written(found).withColumn("n", F.row_number().over(per_ask.orderBy(F.desc("near")))).withColumn("last", last)
            .where(F.col("near") >= F.coalesce(F.col("last") - F.col("slack"), F.lit(0.0))).select("asking", "vector"))

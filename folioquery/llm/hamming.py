"""Exact top-k search of 64-bit codes by incremental multi-index hashing.

A code is cut into segments, and each segment is an index of its own. Two codes within distance m (r + 1) - 1 agree up to
r bits in at least one of m segments. So a query looks up, radius by radius, all segment values at that radius, verifies
the codes found, and ends when its k-th verified distance is covered. When looking up one more radius would cost more than
the codes there are, the queries left are compared with all codes in blocks, which is exact too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from folioquery.llm.common import written

BITS = 64
BLOCK = 2048


def sign_codes(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, code): bit i is set where component i is positive; null components count as not positive.

    Null and empty vectors and null ids take no part. A vector of more than 64 components is an error.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.zeros(batch.num_rows, dtype=np.uint64)
            for k, vector in enumerate(batch.column("v")):
                if len(vector.values) > BITS:
                    raise ValueError(f"vectors of at most {BITS} components fit a code")
                values = np.array([x is not None and x > 0 for x in vector.values.to_pylist()], dtype=np.uint64)
                codes[k] = (values << np.arange(len(values), dtype=np.uint64)).sum(dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(codes.view(np.int64))], ["id", "code"])

    valid = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("v")).where("id IS NOT NULL AND size(v) > 0")
    return valid.mapInArrow(run, "id long, code long")


def segments(codes: int) -> list[tuple[int, int]]:
    """(shift, bits) of each segment: one bit narrower than log2 of the number of codes, so that a lookup meets two
    entries or more and one radius less is needed than with wider segments."""
    count = max(2, math.ceil(BITS / max(4, math.ceil(math.log2(max(codes, 2))) - 1)))
    edges = [BITS * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def segment(code: Column, shift: int, bits: int) -> Column:
    return F.shiftrightunsigned(code, shift).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def nearest(codes: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, id, distance: the k rows nearest to each query, itself not included, ties to the smaller id.

    Both tables have (id, code). Rows with equal codes form one entry of the index, which keeps its k + 1 smallest ids:
    no query can use more of them. With k or fewer other rows all are returned. Repeated ids count once.
    """
    spot = F.row_number().over(W.partitionBy("code").orderBy("id"))
    members = written(codes.dropDuplicates(["id", "code"]).withColumn("nth", spot).where(F.col("nth") <= k + 1))
    entries = written(members.groupBy("code").agg(F.max("nth").cast("long").alias("rows")))
    total = entries.agg(F.count("*"), F.sum("rows")).first()
    size, cuts = total[0], segments(total[0])
    pending = written(queries.select(F.col("code").alias("q")).distinct())
    index = written(entries.select("code", "rows", F.posexplode(F.array(*(segment(F.col("code"), *cut) for cut in cuts))).alias("part", "value")))
    found, results = None, []
    for radius in range(max(bits for _, bits in cuts) + 1):
        flips = [[sum(1 << i for i in chosen) for chosen in combinations(range(bits), radius)] if math.comb(bits, radius) <= size else None
                 for _, bits in cuts]
        if any(f is None for f in flips) or sum(map(len, flips)) > size:
            break
        probes = [pending.select("q", F.lit(part).alias("part"), segment(F.col("q"), *cut).alias("base"))
                  .select("q", "part", F.explode(F.transform(F.lit(flip).cast("array<long>"), _flipped)).alias("value"))
                  for part, (cut, flip) in enumerate(zip(cuts, flips)) if flip]
        looked_up = probes[0]
        for more in probes[1:]:
            looked_up = looked_up.union(more)
        # The planner takes exploded values for a small table; without the hint it would send them to every executor.
        new = looked_up.hint("merge").join(index.hint("merge"), ["part", "value"]).select("q", "code", "rows").distinct().withColumn("distance", distance(F.col("q"), F.col("code")))
        found = written(new if found is None else new.union(found.join(pending, "q", "left_semi")).distinct())
        covered = len(cuts) * (radius + 1) - 1
        near = found.where(F.col("distance") <= covered)
        done = near.groupBy("q").agg(F.sum("rows").alias("n")).where(F.col("n") > k).select("q")
        done = written(done)
        results.append(near.join(done, "q", "left_semi").select("q", "code", "distance"))
        pending = written(pending.join(done, "q", "left_anti"))
        if pending.isEmpty():
            break
    results.append(_against_all(pending, entries, k))
    hits = results[0]
    for more in results[1:]:
        hits = hits.union(more)
    # Only entries that can be among the k nearest meet the members: those before k + 1 rows are gathered.
    before = W.partitionBy("q").orderBy("distance").rangeBetween(W.unboundedPreceding, -1)
    hits = (hits.join(entries, "code").withColumn("nearer", F.coalesce(F.sum("rows").over(before), F.lit(0)))
            .where(F.col("nearer") <= k).select("q", "code", "distance"))
    asked = queries.select(F.col("id").alias("query_id"), F.col("code").alias("q")).distinct()
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "id"))
    return (asked.join(hits, "q").join(members.select("id", "code"), "code").where("id <> query_id")
            .select("query_id", rank.alias("rank"), "id", "distance").where(F.col("rank") <= k))


def _flipped(mask: Column) -> Column:
    return F.col("base").bitwiseXOR(mask)


def _blocks(rows: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """Rows gathered into blocks of about BLOCK by a hash."""
    count = max(1, math.ceil(rows.count() / BLOCK))
    return rows.groupBy(F.pmod(F.xxhash64(key), F.lit(count)).alias(name)).agg(F.collect_list(value).alias(f"{name}_rows"))


def _against_all(pending: DataFrame, entries: DataFrame, k: int) -> DataFrame:
    """Queries left over against all entries, in blocks; each pair of blocks keeps what can be among the k nearest."""
    asked = _blocks(pending, "q", F.col("q"), "qb")
    blocks = _blocks(entries, "code", F.struct("code", "rows"), "eb")
    numbers = blocks.agg(F.collect_list("eb").alias("all")).select(F.explode("all").alias("eb"))  # one number per block
    spread = asked.join(F.broadcast(numbers))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for qs, listed in zip(batch.column("qb_rows"), batch.column("eb_rows")):
                codes, rows = (listed.values.field(x).to_numpy() for x in ("code", "rows"))
                out = []
                for q in qs.as_py():
                    d = np.bitwise_count((codes ^ np.int64(q)).view(np.uint64)).astype(np.int32)
                    order = np.argsort(d, kind="stable")
                    last = d[order][min(int(np.searchsorted(np.cumsum(rows[order]), k + 1)), len(order) - 1)]
                    keep = d <= last
                    out.append((np.full(int(keep.sum()), q, dtype=np.int64), codes[keep], d[keep]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["q", "code", "distance"])

    return spread.join(blocks, "eb").select("qb_rows", "eb_rows").mapInArrow(run, "q long, code long, distance int")

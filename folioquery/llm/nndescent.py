"""Approximate nearest neighbours: an NN-descent graph, and greedy search in it.

The graph starts from blocks of vectors that are close in the order of random projections. Each round joins, around
every centre, its neighbours and the nodes it is a neighbour of; any two of them that meet there and beat the present
lists replace their worst entries. Vectors are lengthened by one component to equal norms, so that the largest inner
product is the smallest distance; graph and walk use half-precision copies, final scores the vectors as given. Queries walk the graph from their own node and from pivots, expanding the best
nodes not yet expanded, until nothing among the best is left to expand. Equal vectors are one node.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from folioquery.llm.common import removed, written

NEIGHBOURS = 32     # kept per node of the graph
BLOCK = 512         # vectors compared with each other at the start
ORDERS = 8          # random orders that are cut into blocks
SETTLED = 0.01      # a round that changes a smaller share of the entries is the last
BEAM = 224          # least number of best nodes kept per query
PIVOTS = 256        # least number of start nodes every query is compared with (broadcast)
DOUBLING = 20       # best nodes and start nodes for each doubling of the table, if that is more
WIDTH = 45          # nodes expanded per query and step
ENDLESS = 200       # rounds or steps after which an error is raised: neither should take a tenth of them
HALF = "<f2"


# -- vectors -----------------------------------------------------------------------------------------------------------
def usable(vectors: DataFrame, id_column: str, vector_column: str) -> tuple[DataFrame, str]:
    """(vec_id, vec) of the vectors that take part, and the number format of the bytes in vec.

    Null ids and vectors that are null, empty, zero or hold a null or non-finite component take no part, nor do
    vectors of another length than the most frequent one (of two equally frequent, the shorter). Of rows that repeat a
    vec_id in that length the smallest bytes count.
    """
    kind = "<f8" if "double" in vectors.schema[vector_column].dataType.simpleString() else "<f4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for i, vector in zip(batch.column("vec_id").to_pylist(), batch.column("v")):
                if not vector.is_valid or vector.values.null_count or i is None:
                    continue
                x = vector.values.to_numpy(zero_copy_only=False).astype(kind) + 0.0
                if len(x) and np.isfinite(x).all() and x.any():
                    ids.append(i)
                    out.append(x.astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["vec_id", "vec"])

    found = (vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).alias("v"))
             .mapInArrow(run, "vec_id long, vec binary").groupBy("vec_id", F.length("vec").alias("n")).agg(F.min("vec").alias("vec")))
    found = written(found)
    size = found.groupBy("n").count().orderBy(F.desc("count"), "n").first()
    return found.where(F.col("n") == F.lit(size["n"] if size else 0)).select("vec_id", "vec"), kind


def matrix(column, kind: str) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype=kind).reshape(len(rows), -1) if rows else np.zeros((0, 1), dtype=kind)


def facts(nodes: DataFrame, kind: str) -> tuple[int, float, np.ndarray]:
    """Number of nodes, largest squared norm and mean vector; one row per partition reaches the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, top, total = 0, 0.0, None
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("vec"), kind).astype(np.float64)
                n, top = n + len(x), max(top, float((x * x).sum(axis=1).max()))
                total = x.sum(axis=0) if total is None else total + x.sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([top]), pa.array([total.tolist()])], ["n", "top", "total"])

    rows = nodes.select("vec").mapInArrow(run, "n long, top double, total array<double>").collect()
    n = sum(r.n for r in rows)
    return n, max((r.top for r in rows), default=0.0), sum((np.array(r.total) for r in rows), np.zeros(1)) / max(n, 1)


# -- graph -------------------------------------------------------------------------------------------------------------
LISTS = "node long, nbrs array<long>, sims array<float>"


def list_batch(nodes, nbrs: list, sims: list) -> pa.RecordBatch:
    offsets = pa.array(np.cumsum([0, *map(len, nbrs)]), pa.int32())
    flat = lambda parts, t: pa.array(np.concatenate([*parts, np.zeros(0, dtype=t)]).astype(t))
    return pa.RecordBatch.from_arrays(
        [pa.array(nodes, pa.int64()), pa.ListArray.from_arrays(offsets, flat(nbrs, np.int64)),
         pa.ListArray.from_arrays(offsets, flat(sims, np.float32))], ["node", "nbrs", "sims"])


def best_lists(ids: np.ndarray, sims: np.ndarray, above: np.ndarray | None = None) -> tuple[list, list]:
    """For each row of a square similarity matrix the best other nodes, if they beat ``above``."""
    sims[ids[:, None] == ids[None, :]] = -np.inf
    keep = min(NEIGHBOURS, len(ids) - 1)
    if keep <= 0:
        return [np.zeros(0, dtype=np.int64)] * len(ids), [np.zeros(0, dtype=np.float32)] * len(ids)
    top = np.argpartition(-sims, keep - 1, axis=1)[:, :keep]
    values = np.take_along_axis(sims, top, axis=1)
    good = values > (np.full(len(ids), -np.inf) if above is None else above)[:, None]
    return [ids[t[g]] for t, g in zip(top, good)], [v[g] for v, g in zip(values, good)]


def blocks(nodes: DataFrame, count: int, centre: np.ndarray) -> DataFrame:
    """Neighbour lists inside blocks of vectors that follow each other in several random orders.

    An order sorts by the sides of a few random planes and the place along a direction. All orders are sorted at once,
    one after the other; blocks are cut from the sorted ranges.
    """
    orders = ORDERS if count > BLOCK else 1
    bits = max(1, math.ceil(math.log2(max(count / BLOCK, 2))))
    plane = np.random.default_rng(5).normal(size=(len(centre), orders * (bits + 1)))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = ((matrix(batch.column("vec"), HALF).astype(np.float64) - centre) @ plane if batch.num_rows
                    else np.zeros((0, orders * (bits + 1))))
            for n in range(orders):
                part = seen[:, n * (bits + 1):(n + 1) * (bits + 1)]
                key = ((part[:, :bits] > 0) << np.arange(bits)).sum(axis=1) + (n << bits)
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(part[:, bits]), *batch.columns],
                                                 ["key", "along", *batch.schema.names])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def compare(table: pa.Table) -> pa.RecordBatch:
            x, extra = matrix(table["vec"], HALF).astype(np.float32), table["extra"].to_numpy().astype(np.float32)
            ids = table["node"].to_numpy()
            return list_batch(ids, *best_lists(ids, x @ x.T + np.outer(extra, extra)))

        for batch in batches:
            waiting.append(batch)
            table = pa.Table.from_batches(waiting)
            whole = table.num_rows // BLOCK * BLOCK
            for start in range(0, whole, BLOCK):
                yield compare(table.slice(start, BLOCK))
            waiting = table.slice(whole).combine_chunks().to_batches()
        if waiting and sum(b.num_rows for b in waiting):
            yield compare(pa.Table.from_batches(waiting))

    placed = written(nodes.mapInArrow(keys, "key long, along double, node long, vec binary, extra double"))
    return placed.repartitionByRange("key", "along", "node").sortWithinPartitions("key", "along", "node").mapInArrow(cut, LISTS)


GRAPH = f"{LISTS}, fresh int, vec binary, extra double"


def merged_lists(lists: DataFrame) -> DataFrame:
    """One row per node: its best distinct neighbours, its vector, and how many neighbours are new.

    ``lists`` holds lists on offer (new, without vector) and present ones (with the vector of the node).
    """
    grouped = lists.groupBy("node").agg(F.collect_list(F.struct("nbrs", "sims", "new")).alias("all"),
                                        F.max("vec").alias("vec"), F.max("extra").alias("extra"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nbrs, sims, fresh = [], [], []
            for every in batch.column("all"):
                parts = every.values
                ids = parts.field("nbrs").flatten().to_numpy()
                values = parts.field("sims").flatten().to_numpy()
                new = np.repeat(parts.field("new").to_numpy(zero_copy_only=False), parts.field("nbrs").value_lengths().to_numpy())
                order = np.lexsort((new, ids, -values))
                _, first = np.unique(ids[order], return_index=True)
                take = order[np.sort(first)][:NEIGHBOURS]
                nbrs.append(ids[take])
                sims.append(values[take])
                fresh.append(len(np.setdiff1d(ids[take], ids[~new])))
            out = list_batch(batch.column("node"), nbrs, sims)
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(fresh, pa.int32()), batch.column("vec"), batch.column("extra")],
                                             [*out.schema.names, "fresh", "vec", "extra"])

    return grouped.mapInArrow(run, GRAPH)


def around(graph: DataFrame) -> DataFrame:
    """(centre, node): a node's neighbours and the closest of the nodes it is a neighbour of; pairs may repeat."""
    edges = graph.select("node", F.explode(F.arrays_zip("nbrs", "sims")).alias("e")).select("node", F.col("e.nbrs").alias("nbr"), F.col("e.sims").alias("sim"))
    nearest = F.row_number().over(W.partitionBy("nbr").orderBy(F.desc("sim"), "node"))
    back = edges.withColumn("nth", nearest).where(F.col("nth") <= NEIGHBOURS).select(F.col("nbr").alias("centre"), "node")
    return edges.select(F.col("node").alias("centre"), F.col("nbr").alias("node")).union(back)


def joined_round(graph: DataFrame) -> DataFrame:
    """Lists that any two nodes around a common centre offer each other, above what they have already."""
    worst = F.when(F.size("sims") >= NEIGHBOURS, F.array_min("sims")).otherwise(F.lit(float("-inf"))).cast("float")
    around_it = around(graph).union(graph.select(F.col("node").alias("centre"), "node"))
    rows = (around_it.join(graph.select("node", "vec", "extra", worst.alias("worst")), "node")
            .repartition("centre").sortWithinPartitions("centre", "node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in chain(batches, [None]):
            table = held if batch is None else pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if table is None or not table.num_rows:
                continue
            centre = table["centre"].to_numpy()
            starts = np.flatnonzero(np.append(True, centre[1:] != centre[:-1]))
            if batch is not None:  # the last centre may go on in the next batch
                held, table = table.slice(starts[-1]).combine_chunks(), table.slice(0, starts[-1])
                starts = starts[:-1]
            if not len(starts):
                continue
            ids, x = table["node"].to_numpy(), matrix(table["vec"], HALF).astype(np.float32)
            x = np.column_stack([x, table["extra"].to_numpy().astype(np.float32)])
            above = table["worst"].to_numpy()
            who, nbrs, sims = [], [], []
            for a, b in zip(starts, np.append(starts[1:], len(ids))):
                at = a + np.unique(ids[a:b], return_index=True)[1]
                found, values = best_lists(ids[at], x[at] @ x[at].T, above[at])
                for i, f, v in zip(ids[at].tolist(), found, values):
                    if len(f):
                        who.append(i)
                        nbrs.append(f)
                        sims.append(v)
            yield list_batch(who, nbrs, sims)

    return rows.select("centre", "node", "vec", "extra", "worst").mapInArrow(run, LISTS)


def neighbour_graph(nodes: DataFrame, count: int, centre: np.ndarray) -> DataFrame:
    """(node, nbrs, sims, fresh, vec, extra): the graph after the first round that changes hardly anything."""
    def offered(lists: DataFrame) -> DataFrame:
        return lists.withColumns({"new": F.lit(True), "vec": F.lit(None).cast("binary"), "extra": F.lit(None).cast("double")})

    def present(rows: DataFrame) -> DataFrame:
        return rows.select("node", "nbrs", "sims", F.lit(False).alias("new"), "vec", "extra")

    none = nodes.withColumns({"nbrs": F.array().cast("array<long>"), "sims": F.array().cast("array<float>")})
    graph = written(merged_lists(offered(blocks(nodes, count, centre)).union(present(none))))
    for n in range(ENDLESS + 1 if count > BLOCK else 0):
        if n == ENDLESS:
            raise RuntimeError(f"the neighbour graph has not settled after {n} rounds")
        after = written(merged_lists(offered(joined_round(graph)).union(present(graph))))
        removed(graph)
        graph = after
        if graph.agg(F.sum("fresh")).first()[0] < SETTLED * NEIGHBOURS * count:
            break
    return graph


# -- search ------------------------------------------------------------------------------------------------------------
STATE = "query_id long, qvec binary, ids array<long>, scores array<double>, expanded array<boolean>, todo array<long>"


def state_batch(query_ids, qvecs, states: list[tuple], beam: int, width: int) -> pa.RecordBatch:
    """Keep the best of each query and pick what it expands next."""
    ids, scores, expanded, todo = [], [], [], []
    for i, s, e in states:
        order = np.lexsort((i, -s))[:beam]
        i, s, e = i[order], s[order], e[order]
        next_up = np.flatnonzero(~e)[:width]
        e[next_up] = True
        ids.append(i)
        scores.append(s)
        expanded.append(e)
        todo.append(i[next_up])
    lists = [pa.array(x, pa.list_(t)) for x, t in ((ids, pa.int64()), (scores, pa.float64()), (expanded, pa.bool_()), (todo, pa.int64()))]
    return pa.RecordBatch.from_arrays([query_ids, qvecs, *lists], ["query_id", "qvec", "ids", "scores", "expanded", "todo"])


def greedy_search(queries: DataFrame, graph: DataFrame, nodes: DataFrame, kind: str, count: int) -> DataFrame:
    """(query_id, node, score) of the best nodes found; ``queries`` has query_id, qvec and own (its node or null).

    Best nodes and start nodes grow with the logarithm of ``count``; the walk ends when all best ones are expanded.
    """
    more_nodes = math.ceil(DOUBLING * math.log2(max(count, 2)))
    beam, width = max(BEAM, more_nodes), WIDTH
    links = written(around(graph).groupBy("centre").agg(F.collect_set("node").alias("linked")))  # at most 2 x NEIGHBOURS
    chosen = nodes.orderBy(F.xxhash64("node"), "node").limit(max(PIVOTS, more_nodes)).select("node", "vec").toArrow()
    pivots = queries.sparkSession.sparkContext.broadcast((chosen["node"].to_numpy(), matrix(chosen["vec"], HALF).astype(np.float64)))

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = pivots.value
        for batch in batches:
            if batch.num_rows:
                scores = matrix(batch.column("qvec"), kind).astype(np.float64) @ x.T
                states = []
                for own, q, s in zip(batch.column("own").to_pylist(), matrix(batch.column("qvec"), kind).astype(np.float64), scores):
                    more = own is not None and own not in ids
                    i, v = (np.append(ids, own), np.append(s, q @ q)) if more else (ids, s)
                    e = np.zeros(len(i), dtype=bool)
                    states.append((i, v, e))
                yield state_batch(batch.column("query_id"), batch.column("qvec"), states, beam, width)

    state = written(queries.select("query_id", "qvec", "own").mapInArrow(begin, STATE))
    for n in range(ENDLESS * max(1, math.ceil(beam / width))):
        if state.where(F.size("todo") > 0).isEmpty():
            break
        met = (state.select("query_id", F.explode("todo").alias("centre")).join(links, "centre")
               .select("query_id", F.explode("linked").alias("node")).distinct())
        offered = (met.join(nodes.select("node", "vec"), "node").groupBy("query_id")
                   .agg(F.collect_list(F.struct("node", "vec")).alias("offered")))  # at most WIDTH x 2 x NEIGHBOURS

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                states = []
                for q, ids, scores, expanded, new in zip(batch.column("qvec").to_pylist(), *(batch.column(x) for x in ("ids", "scores", "expanded", "offered"))):
                    i, s = ids.values.to_numpy(), scores.values.to_numpy()
                    e = expanded.values.to_numpy(zero_copy_only=False)
                    if new.is_valid:
                        met_ids = new.values.field("node").to_numpy()
                        fresh = ~np.isin(met_ids, i)
                        x = matrix(new.values.field("vec"), HALF)[fresh].astype(np.float64)
                        i = np.append(i, met_ids[fresh])
                        s = np.append(s, x @ np.frombuffer(q, dtype=kind).astype(np.float64))
                        e = np.append(e, np.zeros(len(x), dtype=bool))
                    states.append((i, s, e))
                yield state_batch(batch.column("query_id"), batch.column("qvec"), states, beam, width)

        after = written(state.join(offered, "query_id", "left").mapInArrow(step, STATE))
        removed(state)
        state = after
    else:
        raise RuntimeError(f"the search has nodes left to expand after {n + 1} steps")
    return state.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("r")).select("query_id", F.col("r.ids").alias("node"), F.col("r.scores").alias("score"))


def nearest(vectors: DataFrame, asked, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest inner product found for each row that ``asked`` selects.

    ``asked`` is a condition on vec_id. A query is no candidate of its own; ties go to the smaller vec_id; with
    fewer candidates all are returned. Every vector that takes part (see ``usable``) is a node of the graph or stands for
    an equal one: a node keeps its k + 1 smallest ids, more of which no query can use.
    """
    rows, kind = usable(vectors, id_column, vector_column)
    nth = F.row_number().over(W.partitionBy("vec").orderBy("vec_id"))
    members = written(rows.withColumn("nth", nth).where(F.col("nth") <= k + 1).withColumn("node", F.min("vec_id").over(W.partitionBy("vec"))))
    single = members.where("nth = 1").select("node", "vec")
    count, top, centre = facts(single, kind)

    scale = math.sqrt(top) or 1.0

    def lengthened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("vec"), kind).astype(np.float64) / scale
                extra = np.sqrt(np.maximum(1 - (x * x).sum(axis=1), 0))
                half = [row.tobytes() for row in x.astype(HALF)]
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(half, pa.binary()), pa.array(extra)], ["node", "vec", "extra"])

    nodes = written(single.mapInArrow(lengthened, "node long, vec binary, extra double"))
    graph = neighbour_graph(nodes, count, centre / scale)
    asking = rows.where(asked).select(F.col("vec_id").alias("query_id"), F.col("vec").alias("qvec"))
    queries = written(asking.join(single.select(F.col("node").alias("own"), F.col("vec").alias("qvec")), "qvec", "left"))
    walked = greedy_search(queries, graph, nodes, kind, count)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, x = (matrix(batch.column(c), kind).astype(np.float64) for c in ("qvec", "vec"))
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("node"), pa.array((q * x).sum(axis=1))],
                                             ["query_id", "node", "score"])

    hits = (walked.join(single, "node").join(asking, "query_id").select("query_id", "node", "qvec", "vec")
            .mapInArrow(exact, "query_id long, node long, score double"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return (hits.join(members.select("node", "vec_id"), "node").where("vec_id <> query_id")
            .select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k))

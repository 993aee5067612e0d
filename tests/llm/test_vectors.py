"""Nearest neighbours and binary codes against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioquery.llm import hamming, nndescent

VECTORS = "vec_id long, embedding array<float>, rank int, node string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], VECTORS).repartition(3)


def brute(rows, asked, k):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=np.float32).astype(float)
    out = {}
    for q in asked:
        score = x @ x[ids == q][0]
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), score[i]) for i in order]
    return out


def test_recall_of_graph_search(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=16) * (0.5 + i % 3)).tolist()) for i in range(1500)]
    got = {}
    for r in nndescent.nearest(vectors(spark, rows), F.col("vec_id") % 50 == 0, k=10).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    want = brute(rows, list(range(0, 1500, 50)), 10)
    assert got.keys() == want.keys()
    hits = [len({v for v, _ in got[q].values()} & {v for v, _ in want[q]}) / 10 for q in want]
    assert np.mean(hits) >= 0.9
    lookup = {q: dict(brute(rows, [q], 1499)[q]) for q in want}
    for q, found in got.items():
        assert sorted(found) == list(range(1, 11))
        assert all(abs(lookup[q][v] - s) < 1e-9 for v, s in found.values())


def test_equal_odd_and_few_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [3.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]),
            (7, [None, 1.0]), (8, []), (9, [1.0, 2.0]), (10, [-1.0, -1.0]), (11, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (2, [3.0, 0.0])]
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in nndescent.nearest(vectors(spark, rows), F.col("vec_id") % 5 == 0, k=3).collect())
    assert got == [(0, 1, 1, 5.0), (0, 2, 9, 5.0), (0, 3, 2, 3.0), (10, 1, 0, -3.0), (10, 2, 1, -3.0), (10, 3, 2, -3.0)]
    assert nndescent.nearest(vectors(spark, rows).limit(0), F.col("vec_id") >= 0, k=3).collect() == []
    many = [(i, [1.0, 0.5]) for i in range(60)] + [(60, [2.0, 2.0])]
    top = nndescent.nearest(vectors(spark, many), F.col("vec_id") == 30, k=5).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in top] == [(60, 3.0)] + [(i, 1.25) for i in range(4)]


@pytest.mark.parametrize("count, spread", [(400, 6), (60, 30), (5, 3)])
def test_codes_against_brute_force(spark, count, spread):
    rng = np.random.default_rng(count)
    centre = rng.integers(0, 2, (8, 64))
    codes = []
    for i in range(count):
        bits = centre[i % 8].copy()
        bits[rng.integers(0, 64, spread)] ^= 1
        codes.append((i, int(np.packbits(bits, bitorder="little").view(np.int64)[0])))
    codes += [(1000 + i, codes[0][1]) for i in range(30)]
    frame = spark.createDataFrame(codes, "id long, code long")
    asked = [c for c in codes if c[0] % 50 == 0]
    got = {}
    for r in hamming.nearest(frame, spark.createDataFrame(asked, "id long, code long"), k=7).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id, r.distance))
    for q, code in asked:
        near = sorted(((code ^ c) & (2**64 - 1)).bit_count() * 10**6 + i for i, c in codes if i != q)[:7]
        assert sorted(got[q]) == [(n + 1, x % 10**6, x // 10**6) for n, x in enumerate(near)]


def test_codes_of_odd_vectors(spark):
    rows = vectors(spark, [(1, [1.0, -1.0, None]), (2, None), (None, [1.0]), (3, [])])
    assert [tuple(r) for r in hamming.sign_codes(rows, "vec_id", "embedding").collect()] == [(1, 1)]
    none = hamming.sign_codes(rows, "vec_id", "embedding").where("id < 0")
    assert hamming.nearest(none, none).collect() == []


def test_walk_and_rounds_go_on_until_nothing_changes(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=24).tolist()) for i in range(1500)]
    for name, value in {"ORDERS": 1, "BLOCK": 40, "NEIGHBOURS": 8, "SETTLED": 0.0005, "WIDTH": 20, "PIVOTS": 1}.items():
        monkeypatch.setattr(nndescent, name, value)
    walks, plain = [], nndescent.greedy_search
    monkeypatch.setattr(nndescent, "greedy_search", lambda *a: walks.append((a, plain(*a))) or walks[-1][1])
    nndescent.nearest(vectors(spark, rows), F.col("vec_id") % 150 == 0, k=10)
    (_, graph, nodes, *_), walked = walks[0]
    assert graph.agg(F.sum("fresh")).first()[0] < 0.0005 * 8 * 1500
    half = {r.node: np.frombuffer(r.vec, nndescent.HALF).astype(float) for r in nodes.collect()}
    links, best = {}, {}
    for r in nndescent.around(graph).collect():
        links.setdefault(r.centre, set()).add(r.node)
    for r in walked.collect():
        best.setdefault(r.query_id, set()).add(r.node)
    assert sorted(best) == list(range(0, 1500, 150))
    for q, found in best.items():
        x = np.array(rows[q][1], dtype=np.float32).astype(float)
        met = set().union(*(links[i] for i in found)) - found
        assert max(half[i] @ x for i in met) <= min(half[i] @ x for i in found) + 1e-9


def test_one_row_of_odd_length_shuts_out_no_other(spark):
    rows = vectors(spark, [(0, [1.0]), (1, [1.0, 2.0]), (2, [3.0, 0.0]), (2, [1.0]), (3, [1.0, 1.0])])
    found, _ = nndescent.usable(rows, "vec_id", "embedding")
    got = {r.vec_id: np.frombuffer(r.vec, "<f4").tolist() for r in found.collect()}
    assert got == {1: [1.0, 2.0], 2: [3.0, 0.0], 3: [1.0, 1.0]}

"""Random projections: recall against the full search, buckets, odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioquery.operators import dense, hashing

ROWS = "chunk_key string, category string, vector array<float>"


def vectors(spark, data):
    rows = [(f"k{i:05d}", "AB"[i % 2], [float(x) for x in np.float32(v)]) for i, v in enumerate(data)]
    return spark.createDataFrame(rows, ROWS)


def asked(df, filtered=False):
    return df.select(F.col("chunk_key").alias("question_id"), "vector", F.col("category") if filtered else F.lit(None).cast("string").alias("category"))


def found(df):
    return {(r.question_id, r.chunk_key): r.score for r in df.collect()}


@pytest.mark.parametrize("size, structure", [(600, 0.0), (3000, 0.0), (3000, 1.0)])
def test_recall_against_the_full_search(spark, size, structure):
    rng = np.random.default_rng(size)
    data = rng.normal(size=(size, 64)) + structure * rng.normal(size=(30, 64))[rng.integers(0, 30, size)]
    df = vectors(spark, data)
    questions = asked(df).where(F.crc32("question_id") % 10 == 0)
    want = found(dense.dense_topk(questions, df, k=5))
    got = found(hashing.hashed_topk(questions, df, hashing.projections(64), k=5))
    assert all(abs(got[p] - want[p]) < 1e-9 for p in got.keys() & want.keys())
    assert len(got.keys() & want.keys()) / len(want) >= 0.9


def test_all_probes_equal_the_full_search(spark, monkeypatch):
    monkeypatch.setattr(hashing, "SLICE_ROWS", 7)  # buckets fall into slices
    rng = np.random.default_rng(1)
    data = rng.normal(size=(200, 8))
    data[50:90] = data[50]  # one bucket holds many copies
    data[3] = 0.0
    df = vectors(spark, data)
    planes = hashing.projections(8, tables=3, bits=4)
    assert np.allclose(planes[0] @ planes[0].T, np.eye(4))
    for filtered in (False, True):
        want = found(dense.dense_topk(asked(df, filtered), df, k=7, threshold=0.2))
        assert found(hashing.hashed_topk(asked(df, filtered), df, planes, 0.2, k=7, probes=16)) == want
    none = df.limit(0)
    assert found(hashing.hashed_topk(asked(none), df, planes)) == {} == found(hashing.hashed_topk(asked(df), none, planes))


def test_probes_start_at_the_own_bucket():
    rng = np.random.default_rng(2)
    unit = rng.normal(size=(50, 16))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    planes = hashing.projections(16, 4, 6)
    codes, sides = hashing.bucket_codes(unit, planes)
    probes = hashing.probed_codes(unit, planes, 5)
    assert (probes[:, :, 0] == codes).all()
    cheapest = np.abs(sides).argmin(axis=2)
    assert (probes[:, :, 1] == codes ^ (1 << cheapest)).all()
    assert all(len(set(row)) == 5 for row in probes.reshape(-1, 5).tolist())

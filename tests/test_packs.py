"""Dense searches hand each question to the scoring once, whatever it looks into."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioquery.operators import dense, hashing


@pytest.fixture
def seen(monkeypatch):
    packs, real = [], dense._score_packs

    def recorded(asks, *rest, **named):
        packs.append(asks)
        return real(asks, *rest, **named)

    for module in (dense, hashing):
        monkeypatch.setattr(module, "_score_packs", recorded)
    return packs


def data(spark, n=120, copies=40):
    rng = np.random.default_rng(4)
    values = rng.normal(size=(n, 16))
    values[-copies:] = values[0]
    rows = [(i, "ABC"[i % 3], [float(x) for x in np.float32(v)]) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "chunk_key long, category string, vector array<float>")
    return df, df.select(F.col("chunk_key").alias("question_id"), "vector", F.lit(None).cast("string").alias("category"))


def asked_vectors(seen):
    return seen[0].agg(F.sum(F.size("keys"))).first()[0]


def test_questions_meet_all_categories_without_copies(spark, seen, monkeypatch):
    monkeypatch.setattr(dense, "PACK_ROWS", 16)
    df, asked = data(spark)
    found = dense.dense_topk(asked, df, k=3)
    assert asked_vectors(seen) == asked.count()
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()
    copies = [r.chunk_key for r in found.where("question_id = 100").orderBy("rank").collect()]
    assert copies == [0, 80, 81]  # of equal scores the smaller keys, in every pack


def test_cells_are_bits_of_a_question(spark, seen):
    df, asked = data(spark)
    dense.cell_topk(asked, df, dense.train_cells(df, cells=4), -1.0)
    assert asked_vectors(seen) == asked.count()


def test_buckets_are_bits_of_a_question(spark, seen):
    df, asked = data(spark)
    found = hashing.hashed_topk(asked, df, hashing.projections(16, tables=3, bits=4), k=3, probes=9)
    assert asked_vectors(seen) == asked.count()
    copies = [r.chunk_key for r in found.where("question_id = 100").orderBy("rank").collect()]
    assert copies == [0, 80, 81]  # met in all tables, listed once

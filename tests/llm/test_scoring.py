"""Quality and toxicity: held-out accuracy on the given tables, and defined results in odd cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioquery.llm import quality, toxicity
from folioquery.llm.common import held_out
from folioquery.llm.linear import descend, platt

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, label string, score double"
LABELS = "doc_id long, quality int, toxic int"


def measured(spark, scores, column):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", column)
    rows = scores.where("held_out").join(labels, "doc_id").select(column, "predicted").collect()
    return np.array([tuple(r) for r in rows])


def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_quality_held_out_accuracy(spark):
    docs, labels = tables(spark)
    scores = quality.quality_scores(docs, labels)
    assert scores.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and scores.count() == docs.count()
    rows = measured(spark, scores, "quality")
    assert (rows[:, 0] == rows[:, 1]).mean() > 0.95


def test_toxicity_leaves_clean_documents_alone(spark):
    docs, labels = tables(spark)
    rows = measured(spark, toxicity.toxicity_scores(docs, labels), "toxic")
    assert rows[rows[:, 0] == 0, 1].mean() < 0.02
    assert rows[rows[:, 0] == 1, 1].mean() > 0.5
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and 0.8 * docs.count() < kept.count() < docs.count()


def test_labels_of_held_out_rows_are_not_learnt(spark):
    docs, labels = tables(spark)
    other = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a = quality.quality_scores(docs, labels).orderBy("doc_id").limit(50).collect()
    assert a == quality.quality_scores(docs, other).orderBy("doc_id").limit(50).collect()


@pytest.mark.parametrize("scored", [quality.quality_scores, toxicity.toxicity_scores])
def test_odd_rows(spark, scored):
    docs = spark.createDataFrame([(1, None, "x", None, None), (None, "", None, "1", 0.5), (2, "a b", None, None, None),
                                  (2, "a b", None, None, None), (3, "w " * 50_000, None, None, None)], DOCS)
    for labels in ([], [(1, None, None), (2, 1, 1)], [(i % 4, i % 2, i % 2) for i in range(12)]):
        rows = scored(docs, spark.createDataFrame(labels, LABELS)).collect()
        assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
        assert all(r.held_out for r in rows if r.doc_id is None)
    assert scored(docs.limit(0), spark.createDataFrame([], LABELS)).collect() == []


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 50, 8) + 50 * (i % 2)).astype(np.int32) for i in range(60)]
    signs = np.array([1.0 if i % 2 else -1.0 for i in range(60)])
    w, b = quality.dual_coordinate_descent(rows, [np.ones(len(r)) / len(r) ** 0.5 for r in rows], signs)
    assert all(np.sign(w[r].sum() + b) == s for r, s in zip(rows, signs))


def test_label_model_finds_accuracies_and_correlations():
    rng = np.random.default_rng(2)
    y = rng.random(20_000) < 0.2
    good = np.where(y, rng.random(len(y)) < 0.9, rng.random(len(y)) < 0.02)
    copy = np.where(rng.random(len(y)) < 0.95, good, ~good)
    weak = np.where(y, rng.random(len(y)) < 0.6, rng.random(len(y)) < 0.3)
    other = np.where(y, rng.random(len(y)) < 0.8, rng.random(len(y)) < 0.05)
    votes = np.column_stack([good, copy, weak, other]).astype(np.int64)
    labels = np.where(rng.random(len(y)) < 0.05, y, -1).astype(np.int64)
    model = toxicity.fit_label_model(votes, labels, np.ones(len(y)))
    assert model.parent[1] == 0  # the copy depends on the voter it repeats
    assert ((model.posterior(votes, np.full(len(y), -1)) > 0.5) == y).mean() > 0.93
    assert abs(model.prior[1] - 0.2) < 0.05


def test_small_numerics():
    x = descend(lambda v: (float(((v - 3) ** 2).sum()), 2 * (v - 3)), np.zeros(4))
    assert np.allclose(x, 3, atol=1e-3)
    slope, offset = platt(np.array([-2.0, -1, 1, 2]), np.array([0, 0, 1, 1]))
    assert slope > 0 and abs(offset) < 1

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from folioquery.functions.vectors import cosine_to_relevance, l2_normalise, relevance_to_cosine
from folioquery.functions.text import chosen_category
from folioquery.operators import dense, lexical
from folioquery.operators.index import read_index
from folioquery.plans.pipeline import answer, ingest
from pyspark.sql import functions as F

CHUNKS = "chunk_key string, category string, text string"
QUESTIONS = "question_id long, question string, category string"


def brute_lexical(chunks, questions, k, threshold):
    words = lambda t: Counter(re.findall(r"[^\W_]+", t.lower()))
    bags = {key: words(text) for key, _, text in chunks}
    df = Counter(t for bag in bags.values() for t in bag)
    idf = lambda t: math.log((1 + len(chunks)) / (1 + df[t])) + 1
    unit = lambda bag: (lambda v, n: {t: x / n for t, x in v.items()})(
        *(lambda v: (v, math.sqrt(sum(x * x for x in v.values()))))({t: c * idf(t) for t, c in bag.items()}))
    vectors = {key: unit(bag) if bag else {} for key, bag in bags.items()}
    out = set()
    for qid, text, only in questions:
        bag = words(text)
        if not bag:
            continue
        q = unit(bag)
        scored = [(-round(sum(w * vectors[key].get(t, 0) for t, w in q.items()), 6), key)
                  for key, category, _ in chunks if not only or only == category]
        for rank, (score, key) in enumerate(sorted(s for s in scored if s[0] < 0)[:k], 1):
            if -score >= threshold:
                out.add((qid, rank, -score, key))
    return out


@pytest.mark.parametrize("threshold", [0.0, 0.2, 0.35, 0.78])
def test_lexical_is_exact(spark, threshold):
    rnd = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    text = lambda: " ".join(rnd.choices(vocabulary, weights, k=rnd.randrange(3, 12)))
    hot = text()
    chunks = [(f"c{i:03d}", rnd.choice("AB"), hot if i % 3 == 0 else text()) for i in range(150)] + [("zz", "A", "...")]
    questions = [(i, rnd.choice([hot, text()]), rnd.choice([None, "", "A", "B"])) for i in range(30)] + \
        [(98, "unknown words only", None), (99, "?!", None)]
    index = lexical.lexical_index(spark.createDataFrame(chunks, CHUNKS), 4)
    got = lexical.lexical_topk(spark.createDataFrame(questions, QUESTIONS), index, 4, threshold).collect()
    assert {tuple(r) for r in got} == brute_lexical(chunks, questions, 4, threshold)


def test_lexical_index_round_trip(spark, tmp_path):
    chunks = spark.createDataFrame([("a", "A", "uno dos"), ("b", "A", "tres cuatro")], CHUNKS)
    asked = spark.createDataFrame([(1, "dos uno", None)], QUESTIONS)
    lexical.save_lexical_index(lexical.lexical_index(lexical.term_counts(chunks)), str(tmp_path))
    got = lexical.lexical_topk(asked, lexical.load_lexical_index(spark, str(tmp_path))).collect()
    assert [tuple(r) for r in got] == [(1, 1, 1.0, "a")]


def vectors(spark, n=300, dim=16, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    data = centres[rng.integers(0, 6, n)] + 0.4 * rng.normal(size=(n, dim))
    data[1] = data[0]
    data[2] = 0.0
    rows = [(f"k{i:03d}", "AB"[i % 2], [float(x) for x in np.float32(v)]) for i, v in enumerate(data)]
    return rows, spark.createDataFrame(rows, "chunk_key string, category string, vector array<float>")


def brute_dense(rows, k, threshold, filtered):
    unit = {key: np.array(v) / np.linalg.norm(v) for key, _, v in rows if np.any(v)}
    out = set()
    for qid, (key, only, _) in enumerate(rows):
        if key not in unit:
            continue
        scored = sorted((-round(float(unit[key] @ unit[other]), 6), other) for other, category, _ in rows
                        if other in unit and (not filtered or category == only))
        out |= {(qid, rank, -s, other) for rank, (s, other) in enumerate(scored[:k], 1) if -s >= threshold}
    return out


@pytest.mark.parametrize("filtered", [False, True])
def test_dense_is_exact(spark, monkeypatch, filtered):
    monkeypatch.setattr(dense, "PACK_ROWS", 32)
    rows, df = vectors(spark)
    asked = spark.createDataFrame([(i, v, c if filtered else None) for i, (_, c, v) in enumerate(rows)],
                                  "question_id long, vector array<float>, category string")
    got = {tuple(r) for r in dense.dense_topk(asked, df, k=3).collect()}
    assert got == brute_dense(rows, 3, -1.0, filtered)


def test_cells_are_exact_and_probes_approximate(spark):
    rows, df = vectors(spark)
    asked = spark.createDataFrame([(i, v, None) for i, (_, _, v) in enumerate(rows)],
                                  "question_id long, vector array<float>, category string")
    centres = dense.train_cells(df, cells=8)
    exact = brute_dense(rows, 5, 0.6, False)
    assert {tuple(r) for r in dense.cell_topk(asked, df, centres, 0.6).collect()} == exact
    near = {(r.question_id, r.chunk_key) for r in dense.cell_topk(asked, df, centres, 0.6, probes=3).collect()}
    assert len(near & {(q, key) for q, _, _, key in exact}) / len(exact) > 0.9


def test_relevance_scale(spark):
    assert relevance_to_cosine(1 - math.sqrt(2) + math.sqrt(2) * 0.8) == pytest.approx(0.8)
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "v array<float>, z array<float>").select(
        l2_normalise(F.col("v")).alias("u"), l2_normalise(F.col("z")).alias("n"),
        cosine_to_relevance(F.lit(1.0)).alias("r")).first()
    assert row.u == [0.6, 0.8] and row.n is None and row.r == 1.0


def test_user_embedder(spark, tmp_path):
    letters = lambda text: F.array(*[F.regexp_count(F.lower(text), F.lit(c)).cast("float") for c in "axyz"])
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "x.md").write_text("## xxxxxxxxx", encoding="utf-8")
    (docs / "y.md").write_text("## yyyyyyyyy", encoding="utf-8")
    ingest(spark, str(docs), str(tmp_path / "ix"), buckets=2, embed=letters)
    chunks = read_index(spark, str(tmp_path / "ix"))
    assert {tuple(r.vector) for r in chunks.collect()} == {(2.0, 9.0, 0.0, 0.0), (2.0, 0.0, 9.0, 0.0)}  # two in "passage: "
    asked = spark.createDataFrame([(1, "xxxx", "Todas"), (2, "zzzz", None)], QUESTIONS).withColumn(
        "category", chosen_category(F.col("category")))
    got = {r.question_id: r for r in answer(asked, chunks, embed=letters).collect()}
    assert [s.file_name for s in got[1].sources] == ["x.md"] and not got[2].used_retrieval

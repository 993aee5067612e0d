"""Many questions of frequent words: vectors are multiplied in blocks, and few pairs go on."""

import random

import pytest

from folioquery.operators import lexical, products
from test_search import CHUNKS, QUESTIONS, brute_lexical


def texts(rnd, n, least, most, words=60):
    weights = [1 / (i + 1) for i in range(words)]
    return [" ".join(rnd.choices([f"w{i}" for i in range(words)], weights, k=rnd.randrange(least, most))) for _ in range(n)]


@pytest.mark.parametrize("threshold, dense, rows, pairs", [(0.0, 0.0, 16, 1 << 22), (0.1, 0.05, 1000, 7), (0.5, 1.0, 7, 100)])
def test_blocks_are_exact(spark, monkeypatch, threshold, dense, rows, pairs):
    for name, value in {"DENSE": dense, "DENSE_TERMS": 5, "SPARSE_PAIRS": pairs, "ASK_ROWS": rows, "VECTOR_ROWS": rows}.items():
        monkeypatch.setattr(products, name, value)
    monkeypatch.setattr(lexical, "_meets_most", lambda *a: True)
    rnd = random.Random(12)
    hot = texts(rnd, 1, 3, 12)[0]
    chunks = [(f"c{i:03d}", rnd.choice("AB"), hot if i % 3 == 0 else t) for i, t in enumerate(texts(rnd, 150, 3, 12))] + [("zz", "A", "...")]
    asked = [(i, rnd.choice([hot, t]), rnd.choice([None, "", "A", "B", "C"])) for i, t in enumerate(texts(rnd, 40, 3, 12))] + \
        [(98, "unknown words only", None), (99, "?!", None), (100, "w0", None)]
    index = lexical.lexical_index(spark.createDataFrame(chunks, CHUNKS), 4)
    got = lexical.lexical_topk(spark.createDataFrame(asked, QUESTIONS), index, 4, threshold).collect()
    assert {tuple(r) for r in got} == brute_lexical(chunks, asked, 4, threshold)


def test_few_pairs_of_many_questions_go_on(spark, monkeypatch):
    rnd = random.Random(13)
    chunks = [(f"c{i:03d}", "A", t) for i, t in enumerate(texts(rnd, 300, 30, 40))]
    asked = [(i, t, None) for i, t in enumerate(texts(rnd, 200, 20, 30))]
    tables, real = [], lexical.written
    monkeypatch.setattr(lexical, "written", lambda df, **options: tables.append(real(df, **options)) or tables[-1])
    index = lexical.lexical_index(spark.createDataFrame(chunks, CHUNKS))
    got = {tuple(r) for r in lexical.lexical_topk(spark.createDataFrame(asked, QUESTIONS), index, threshold=0.1).collect()}
    assert got == brute_lexical(chunks, asked, 5, 0.1)
    pairs = [t.count() for t in tables if sorted(t.columns) == ["asking", "vector"]]
    assert len(pairs) == 1 and pairs[0] < 200 * 10  # of 60,000, nearly all of which reach the threshold

"""Lexical search weighs and moves only what a question may find."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioquery.operators import lexical

CHUNKS = "chunk_key string, category string, text string"


def chunk_rows():
    return [(f"c{i:03d}", "AB"[i % 2], f"alpha beta{i % 7} gamma{i} gamma{i} common") for i in range(60)] + [("z", "A", "delta delta epsilon")]


def test_only_candidates_are_weighed(spark, monkeypatch):
    weighed, real = [], lexical._weighted

    def counted(bags, keys, *rest):
        weighed.append(bags.count())
        return real(bags, keys, *rest)

    monkeypatch.setattr(lexical, "_weighted", counted)
    index = lexical.lexical_index(spark.createDataFrame(chunk_rows(), CHUNKS))
    asked = spark.createDataFrame([(1, "delta epsilon", None), (2, "gamma3 beta3", "B")], "question_id long, question string, category string")
    got = {(r.question_id, r.chunk_key) for r in lexical.lexical_topk(asked, index).where("rank = 1").collect()}
    assert got == {(1, "z"), (2, "c003")}
    assert max(weighed) < 20  # of 61 vectors


@pytest.mark.parametrize("terms", [0, 3, 1 << 16])
def test_least_length_is_near_and_never_above(spark, monkeypatch, terms):
    monkeypatch.setattr(lexical, "FREQUENT_TERMS", max(terms, 1))
    index = lexical.lexical_index(spark.createDataFrame(chunk_rows(), CHUNKS))
    df, n = {r.term: r.df for r in index.stats.collect()}, index.total.first().n
    rows = lexical._with_least_length(index.vectors, index.total, index.stats).select("least", F.col("counts")).collect()
    assert len(rows) == 61
    for r in rows:
        length = math.sqrt(sum((c.tf * (math.log((1 + n) / (1 + df[c.term])) + 1)) ** 2 for c in r.counts))
        assert r.least <= length
        assert terms < 1 << 16 or r.least >= length * (1 - 1e-8)
    assert Counter(len(r.counts) for r in rows) == {4: 60, 2: 1}

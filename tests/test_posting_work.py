"""Posting blocks are made without a shuffle, a vector's length once per vector, and few pairs are scored in full."""

import random

from folioquery.operators import lexical, postings
from folioquery.operators.generations import Draft
from folioquery.operators.index import build_index

VECTORS = "bucket int, first_key string, category string, counts array<struct<term: string, tf: int>>"


def test_posting_blocks_measure_each_vector_once(spark):
    vectors = spark.createDataFrame([(b, f"k{b}{i}", "A", [("x", 3), (f"y{i % 2}", 4)]) for b in range(2) for i in range(6)], VECTORS)
    blocks = postings.posting_blocks(vectors)
    plan = blocks._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not any("Repartition" in line for line in plan)
    generate = next(i for i, line in enumerate(plan) if "Generate inline" in line)
    assert not any("aggregate(" in line for line in plan[:generate])  # above it, it would run for every posting
    rows = blocks.collect()
    found = {(r.bucket, r.term, key, impact) for r in rows for key, impact in zip(r["keys"], r.impacts)}
    assert found == {(b, t, f"k{b}{i}", x) for b in range(2) for i in range(6) for t, x in (("x", 0.6), (f"y{i % 2}", 0.8))}
    assert all(r.top == max(r.impacts) and r.impacts == sorted(r.impacts, reverse=True) for r in rows)


def test_few_pairs_are_scored_in_full(spark, tmp_path, monkeypatch):
    path, rnd = str(tmp_path / "ix"), random.Random(5)
    said = lambda: " ".join(f"w{rnd.randrange(400)}" for _ in range(40))
    rows = [(f"f{i % 5}", None, said(), f"k{i:03d}") for i in range(300)]
    chunks = lexical.term_counts(spark.createDataFrame(rows, "file_name string, category string, text string, chunk_key string"))
    draft = Draft(spark, path)
    build_index(chunks, path, buckets=4, draft=draft)
    postings.add_to_search(draft)
    draft.publish()
    asked = spark.createDataFrame([(i, " ".join(rows[i][2].split()[:24]), None) for i in range(6)], "question_id long, question string, category string")
    scored, real = [], postings._weighted

    def counted(bags, keys, *rest):
        if "bucket" in keys:
            scored.append(bags.count())
        return real(bags, keys, *rest)

    monkeypatch.setattr(postings, "_weighted", counted)
    got = sorted(map(tuple, postings.search(asked, postings.read_search(spark, path), 3, 0.6).collect()))
    assert got == sorted(map(tuple, lexical.lexical_topk(asked, lexical.lexical_index(chunks, 3), 3, 0.6).collect()))
    assert {(i, f"k{i:03d}") for i in range(6)} <= {(r[0], r[3]) for r in got}
    assert sum(scored) < 60  # of 300 chunks, most of which share words with each question

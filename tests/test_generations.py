"""Commits that switch over as a whole, and the search index that follows them."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from folioquery.operators import generations as G, index as I, lexical, postings
from folioquery.plans.pipeline import ingest, open_search, refresh_search, reindex

CHUNKS = "file_name string, category string, text string, chunk_key string"
QUESTIONS = "question_id long, question string, category string"


def chunk_rows(spark, rows):
    return spark.createDataFrame([(f, c, t, f"{f}#{i:04d}") for i, (f, c, t) in enumerate(rows)], CHUNKS)


def content(df):
    return sorted(map(tuple, df.select("file_name", "category", "text").collect()))


def names(spark, rows):
    return spark.createDataFrame([(f,) for f in sorted({r[0] for r in rows})], "file_name string")


def test_readers_see_the_old_or_the_new_rows(spark, tmp_path):
    path = str(tmp_path / "ix")
    old = [(f"f{i}", "L", f"old {i} {j}") for i in range(12) for j in range(3)]
    new = [(f"f{i}", "L", f"new {i}") for i in range(12)]
    I.build_index(chunk_rows(spark, old), path, buckets=4)
    opened = I.read_index(spark, path)  # resolved before the replacement
    seen, done = [], threading.Event()

    def read():
        while not done.is_set():
            seen.append(content(I.read_index(spark, path)))

    reader = threading.Thread(target=read)
    reader.start()
    try:
        I.replace_files(spark, path, chunk_rows(spark, new), names(spark, new), buckets=4)
    finally:
        done.set()
        reader.join()
    assert content(opened) == sorted(old)
    assert seen and all(rows in (sorted(old), sorted(new)) for rows in seen)
    assert content(I.read_index(spark, path)) == sorted(new)


def test_two_writers(spark, tmp_path):
    path = str(tmp_path / "ix")
    I.build_index(chunk_rows(spark, [(f"f{i}", "L", "old") for i in range(20)]), path, buckets=8)
    bucket = {r.f: r.b for r in spark.createDataFrame([(f"f{i}",) for i in range(20)], "f string").select("f", I.bucket(F.col("f"), 8).alias("b")).collect()}
    other = next(f for f in bucket if bucket[f] != bucket["f0"])
    drafts = [G.Draft(spark, path) for _ in range(3)]
    for draft, name in zip(drafts, ("f0", other, "f0")):
        fresh = chunk_rows(spark, [(name, "L", "new")])
        I.replace_files(spark, path, fresh, fresh.select("file_name"), 8, draft)
    assert drafts[0].publish().number == 2
    assert drafts[1].publish().number == 3  # another bucket: both changes hold
    with pytest.raises(G.Overtaken):
        drafts[2].publish()
    assert {f for f, _, t in content(I.read_index(spark, path)) if t == "new"} == {"f0", other}
    assert len(content(I.read_index(spark, path))) == 20


def test_old_generations_are_dropped(spark, tmp_path):
    path = str(tmp_path / "ix")
    for text in ("one", "two", "three"):
        I.build_index(chunk_rows(spark, [("f", "L", text)]), path, buckets=2)
    assert G.drop_old(spark, path, keep=1) == 2
    assert content(I.read_index(spark, path)) == [("f", "L", "three")]
    assert [p.name for p in (tmp_path / "ix" / "_generations").glob("*.json")] == ["000000000003.json"]
    assert len(list((tmp_path / "ix" / "chunks").glob("commit=*"))) == 1
    empty = str(tmp_path / "none")
    I.replace_files(spark, empty, chunk_rows(spark, [("a", "L", "t")]), names(spark, [("b",)]), buckets=2)
    assert content(I.read_index(spark, empty)) == [("a", "L", "t")]


def some_rows(rnd, files, size, text):
    return [(f"f{i:02d}", rnd.choice("AB"), text()) for i in files for _ in range(size)]


def test_blocks_find_what_the_full_search_finds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK_ROWS", 8)
    rnd = random.Random(7)
    vocabulary, weights = [f"w{i}" for i in range(80)], [1 / (i + 1) for i in range(80)]
    text = lambda: " ".join(rnd.choices(vocabulary, weights, k=rnd.randrange(2, 14)))
    hot = text()
    rows = some_rows(rnd, range(20), 12, lambda: hot if rnd.random() < 0.3 else text()) + [("z", None, "w1 w2"), ("z", "A", "..."), ("z", "A", "")]
    chunks = lexical.term_counts(chunk_rows(spark, rows))
    path = str(tmp_path / "ix")
    draft = G.Draft(spark, path)
    I.build_index(chunks, path, buckets=4, draft=draft)
    postings.add_to_search(draft, k=4)
    draft.publish()
    asked = spark.createDataFrame([(i, rnd.choice([hot, text()]), rnd.choice([None, "", "A", "B"])) for i in range(30)]
                                  + [(97, "w0 w1", None), (98, "nothing known", None), (99, "?!", "A"), (100, None, None)], QUESTIONS)
    for threshold in (0.0, 0.35):
        want = sorted(map(tuple, lexical.lexical_topk(asked, lexical.lexical_index(chunks, 4), 4, threshold).collect()))
        got = sorted(map(tuple, postings.search(asked, postings.read_search(spark, path), 4, threshold).collect()))
        assert want and got == want


def test_frequent_words_open_few_postings(spark, tmp_path):
    rnd = random.Random(3)
    words = ["the", "of", "and", "to"]
    long = lambda: " ".join(words + [f"x{rnd.randrange(4000)}" for _ in range(60)])
    rows = [(f"f{i % 9}", "A", long()) for i in range(1500)] + [("s", "A", "the of and to"), ("s", "A", "to and of the the")]
    path = str(tmp_path / "ix")
    draft = G.Draft(spark, path)
    I.build_index(lexical.term_counts(chunk_rows(spark, rows)), path, buckets=4, draft=draft)
    postings.add_to_search(draft)
    draft.publish()
    index = postings.read_search(spark, path)
    asked = spark.createDataFrame([(1, "the of and to", None)], QUESTIONS)
    opened = []
    real = postings.opened_postings

    def counted(wanted, blocks, below=None):
        rows = wanted.join(blocks, "term").where("top >= need")
        opened.append(rows.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0])
        return real(wanted, blocks, below)

    postings.opened_postings = counted
    try:
        got = [r.chunk_key for r in postings.search(asked, index).orderBy("rank").collect()]
    finally:
        postings.opened_postings = real
    assert got == ["s#1500", "s#1501"]
    every = index.blocks.where(F.col("term").isin(words)).agg(F.sum(F.size("keys"))).first()[0]
    assert every == 4 * 1502 and sum(opened) < 0.35 * every


def test_search_index_follows_replaced_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "DELTAS", 1)
    rnd = random.Random(9)
    text = lambda: " ".join(rnd.choices([f"w{i}" for i in range(40)], k=6))
    path, rows = str(tmp_path / "ix"), {}
    for step in range(3):
        files = range(12) if step == 0 else rnd.sample(range(14), 2)
        fresh = some_rows(rnd, files, 3, text) if step != 2 else []
        rows = {**rows, **{f"f{i:02d}": [r for r in fresh if r[0] == f"f{i:02d}"] for i in files}}
        draft = G.Draft(spark, path)
        I.replace_files(spark, path, lexical.term_counts(chunk_rows(spark, fresh)), names(spark, [(f"f{i:02d}",) for i in files]), 8, draft)
        if step != 1:  # the search index may lag behind by some commits
            stale = postings.add_to_search(draft)
            assert step == 0 or len(stale) <= 4
        draft.publish()
    got = postings.read_search(spark, path)
    whole = str(tmp_path / "whole")
    draft = G.Draft(spark, whole)
    I.build_index(I.read_index(spark, path), whole, buckets=8, draft=draft)
    postings.add_to_search(draft)
    draft.publish()
    want = postings.read_search(spark, whole)
    table = lambda df: sorted(map(repr, df.collect()))
    assert table(got.terms) == table(want.terms) and table(got.vectors) == table(want.vectors)
    unfolded = lambda df: table(df.select("bucket", "term", F.explode(F.arrays_zip("keys", "impacts"))))
    assert unfolded(got.blocks) == unfolded(want.blocks)
    assert len(content(I.read_index(spark, path))) == sum(map(len, rows.values()))
    assert G.drop_old(spark, path, keep=1) > 0
    assert table(postings.read_search(spark, path).terms) == table(want.terms)


def test_update_reads_its_buckets_only(spark, tmp_path):
    path = str(tmp_path / "ix")
    chunks = lexical.term_counts(chunk_rows(spark, [(f"f{i}", "A", f"word{i} more") for i in range(40)]))
    draft = G.Draft(spark, path)
    I.build_index(chunks, path, buckets=16, draft=draft)
    postings.add_to_search(draft)
    draft.publish()
    draft = G.Draft(spark, path)
    fresh = lexical.term_counts(chunk_rows(spark, [("f3", "A", "new words")]))
    I.replace_files(spark, path, fresh, fresh.select("file_name"), 16, draft)
    stale = postings.add_to_search(draft)
    assert len(stale) == 1
    for table in (I.CHUNKS, postings.REFLECTED, postings.VECTORS, postings.BLOCKS):
        assert all(f"/bucket={stale[0]}/" in f for f in draft.rows(table, stale).inputFiles())
    change = {c.table: c for c in draft.changes}
    assert change[postings.VECTORS].removed == change[postings.BLOCKS].removed == set(stale)
    assert change[postings.TERMS].removed == set()


def test_refresh_after_reindexing_without(spark, tmp_path):
    docs, path = tmp_path / "docs", str(tmp_path / "ix")
    docs.mkdir()
    (docs / "a.md").write_text("## Uno\nalfa", encoding="utf-8")
    ingest(spark, str(docs), path, buckets=4)
    (docs / "a.md").write_text("## Dos\nbeta", encoding="utf-8")
    reindex(spark, [str(docs / "a.md")], path, buckets=4, refresh=False)
    words = lambda: {r.term for r in open_search(spark, path).terms.collect()}
    assert words() == {None, "uno", "alfa"}
    refresh_search(spark, path)
    assert words() == {None, "dos", "beta"}
    before = G.generation(spark, path).number
    refresh_search(spark, path)
    assert G.generation(spark, path).number == before  # nothing to do

"""The search index moves and keeps counts once, and shuffle files go with the write that made them."""

import random
import time

from pyspark.sql import functions as F

from folioquery.operators import index as I, lexical, postings
from folioquery.operators.generations import Draft
from folioquery.session import dropped, written

CHUNKS = "file_name string, category string, text string, chunk_key string"


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def some_chunks(spark, n=120):
    rnd = random.Random(4)
    text = lambda: " ".join(f"w{rnd.randrange(30)}" for _ in range(rnd.randrange(2, 9)))
    hot = text()
    rows = [(f"f{i % 7}", rnd.choice("AB") if i % 5 else None, hot if i % 3 == 0 else text(), f"k{rnd.randrange(10**9):09d}") for i in range(n)]
    return spark.createDataFrame(rows + [("f1", "A", "", "x1"), ("f1", "A", "?!", "x2"), ("f2", None, None, "x3")], CHUNKS)


def built(spark, chunks, path):
    draft = Draft(spark, path)
    I.build_index(chunks, path, buckets=4, draft=draft)
    postings.add_to_search(draft, k=3)
    draft.publish()
    return postings.read_search(spark, path)


def test_chunks_without_counts_make_the_same_index(spark, tmp_path):
    chunks = some_chunks(spark)
    plain = built(spark, chunks, str(tmp_path / "plain"))
    counted = built(spark, lexical.term_counts(chunks), str(tmp_path / "counted"))
    table = lambda df: sorted(map(repr, df.collect()))
    for got, want in zip(plain, counted):
        assert got.columns == want.columns and table(got) == table(want) != []
    assert {r.term: r.df for r in plain.terms.collect()}[None] == 123


def test_counts_are_moved_once(spark, monkeypatch):
    monkeypatch.setattr(postings, "SHARD_ROWS", 20)
    chunks = lexical.term_counts(some_chunks(spark)).withColumn("bucket", F.lit(1))
    vectors = postings.bucket_vectors(chunks, 3)
    rows = vectors.collect()
    plan = vectors._jdf.queryExecution().executedPlan().toString()
    final = plan.split("Initial Plan")[0]
    assert final.count("Exchange hashpartitioning(bucket") == final.count("Exchange ") == 1
    kept = {}
    for r in chunks.where(F.size("counts") > 0).collect():
        kept.setdefault((r.category or "", tuple(map(tuple, r.counts))), []).append(r.chunk_key)
    assert {(r.category, tuple(map(tuple, r.counts)), tuple(r["keys"])) for r in rows} == {(*g, tuple(sorted(keys)[:3])) for g, keys in kept.items()}
    assert all(r.first_key == r["keys"][0] for r in rows)


def test_copies_of_a_hot_text_stay_in_their_tasks(spark):
    rows = spark.range(0, 4000, 1, 4).select(F.format_string("k%05d", "id").alias("chunk_key"), F.lit(1).alias("bucket"),
                                             F.lit("A").alias("category"), F.lit(b"hot").alias("bag"))
    kept = sorted(r.chunk_key for r in postings._few_copies(rows, 3).collect())
    assert len(kept) == 12 and kept[:3] == ["k00000", "k00001", "k00002"]


def test_shuffles_go_with_their_write_and_tables_when_dropped(spark):
    before = shuffle_files(spark)
    table = written(spark.range(1000).repartition(3, "id").withColumn("x", F.rand()))
    deadline = time.time() + 20
    while shuffle_files(spark) - before and time.time() < deadline:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert table.count() == 1000
    folder = spark._jvm.org.apache.hadoop.fs.Path(table.inputFiles()[0].rpartition("/")[0])
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    assert files.exists(folder)
    dropped(table)
    assert not files.exists(folder)

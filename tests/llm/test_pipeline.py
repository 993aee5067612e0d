"""The pipeline: every stage on its own input, and the whole against its parts."""

import corpus_pipeline
from folioquery.llm import lines, minhash, suffixes

SF = "/root/testdata/sf0.001"


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_are_in_order_and_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line dedup", "near dedup", "suffix dedup", "packing"]
    now, before = docs, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, now = now, stage(spark, now, SF).cache()
        assert now.columns == docs.columns and 0 < now.count() <= before.count()
        assert set(ids(now)) <= set(ids(before))
        if name in ("line dedup", "suffix dedup"):
            assert ids(now) == ids(before)
            assert now.where("n_chars <> length(text)").isEmpty()
        if name == "near dedup":
            found = minhash.near_duplicates(before, 5, 80)
            assert ids(now) == ids(found.where("kept"))
    packed = corpus_pipeline.STAGES[-1][1](spark, now, SF)
    assert set(ids(packed)) == set(ids(now))
    whole = corpus_pipeline.run(spark, SF)
    total = lambda df: df.selectExpr("sum(length)").first()[0]
    assert total(whole) == total(packed) and set(ids(whole)) == set(ids(packed))


def test_cut_texts_hold_no_repeats_any_more(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cut = suffixes.without_repeats(docs, texts=True)
    assert suffixes.without_repeats(cut).where("n_removed > 0").count() <= 2
    assert lines.without_repeated_lines(docs).where("n_removed > 0").count() > 0


def test_a_copy_of_one_long_line_is_cut(spark):
    line = " ".join(f"word{i}" for i in range(50))
    docs = spark.createDataFrame([(1, line), (2, line), (3, "short"), (4, "short")], "doc_id long, text string")
    kept = dict(map(tuple, corpus_pipeline.drop_repeated_lines(spark, docs, SF).select("doc_id", "text").collect()))
    assert kept == {1: line, 2: "", 3: "short", 4: "short"}


def test_a_passage_of_fifty_short_words_is_cut_everywhere(spark):
    passage = " ".join(f"w{i:02d}" for i in range(52))  # 207 bytes
    rows = [(1, f"before one {passage} after one", 9), (2, f"{passage} two", 9), (3, "w00 w01 w02", 9), (4, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    kept = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.drop_repeated_passages(spark, docs, SF).collect()}
    assert kept == {1: ("before one after one", 20), 2: ("two", 3), 3: ("w00 w01 w02", 11), 4: (None, None)}

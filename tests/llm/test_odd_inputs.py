"""Columns that clash, long words and vectors, empty tables in the stages of the pipeline."""

import numpy as np
import pytest

import corpus_pipeline
from folioquery.llm import hamming, lines, minhash, quality, suffixes, toxicity
from folioquery.llm.common import WordHashes

CLASHING = "doc_id long, text string, _key string, _doc long, __text_key int, _starts array<int>, _spans string, n_chars long"


@pytest.mark.parametrize("cut", [
    lambda docs: lines.without_repeated_lines(docs, texts=True), lambda docs: minhash.without_near_duplicates(docs, width=5, percent=80),
    lambda docs: suffixes.without_repeats(docs, texts=True, words=5)])
def test_columns_of_any_name_stay(spark, cut):
    rows = [(i, t, "k", 7, 8, [9], "s", 1) for i, t in enumerate(["a b c d e f", "other words here", None])]
    got = {r.doc_id: r for r in cut(spark.createDataFrame(rows, CLASHING)).collect()}
    assert sorted(got) == [0, 1, 2]
    for i, text, *rest in rows:
        assert got[i].text == text and tuple(got[i])[2:-1] == tuple(rest[:-1])


def test_words_joined_by_signs_and_long_words_count():
    assert toxicity.distinct_tokens("Idiot,moron/TRASH (scum)!") == {"idiot", "moron", "trash", "scum"}
    plain = toxicity.TokenTable(toxicity.token_votes([]))
    assert toxicity.text_votes("x,idiot/y", plain) & 1
    long = "a" * 70 + "worthless"
    assert len(toxicity.word_features(long)) > 40
    assert set(toxicity.word_features(long)) != set(toxicity.word_features("a" * 79))


def test_shapes_are_hashed_whole():
    shapes = quality.ShapeHashes()
    assert shapes["a-1" .encode() * 8 + b"x"] != shapes["a-1".encode() * 8 + b"-"]
    assert isinstance(shapes, WordHashes)


def test_vectors_longer_than_a_code_are_an_error(spark):
    long = spark.createDataFrame([(1, [1.0] * 65)], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="at most 64"):
        hamming.sign_codes(long, "vec_id", "embedding").collect()
    assert hamming.sign_codes(long.limit(0), "vec_id", "embedding").collect() == []


def test_stages_take_null_texts_and_empty_tables(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    columns = "doc_id long, text string, lang string, source string, n_chars long, node string"
    odd = spark.createDataFrame([(1, None, None, None, None, "x"), (2, "", "en", "s", 0, "y"), (None, "a b c", "en", "s", 5, "z")], columns)
    for docs, left in ((odd, {1, 2, None}), (odd.limit(0), set())):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns, name
            # Empty texts are copies of each other to no operator.
            assert {r.doc_id for r in out.collect()} == left, name


def test_multikey_quicksort(monkeypatch):
    monkeypatch.setattr(suffixes, "SMALL", 8)
    rng = np.random.default_rng(4)
    for size in (0, 1, 5, 3000):
        keys = [rng.integers(-3, 3, size), rng.integers(-2**63, 2**63 - 1, size) // 2**62, rng.permutation(size)]
        assert (suffixes.multikey_order(keys) == np.lexsort(keys[::-1])).all()

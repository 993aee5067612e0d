"""Byte pair encoding against the library, packing invariants, and token rollups."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from folioquery.llm import bpe, packing, rollups
from folioquery.llm.common import shared_folder

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ODD = ["", "  a  b", " X", "x ", "\n", "\n\na", "a\n b", "a \nb", "a\tb", "Don't 'S it's", "<|endoftext|>a<|endoftext|>", "日本語 テスト",
       "ÉÀ É a b  c", "x" * 500, "Ab" * 300 + " 12345678", "\x1cfoo\x1d bar\x85z", "🙂🙂 👩‍👩‍👧", "a" + " " * 7 + "b\r\nc", "ΑΣ σ", "İstanbul"]
ENCODERS = {BYTE: bpe.BytePairEncoder(BYTE), WORD: bpe.WordEndEncoder(WORD)}
LIBRARY = {p: Tokenizer.from_file(p) for p in ENCODERS}


@pytest.mark.parametrize("path", list(ENCODERS))
def test_same_ids_as_the_library(path):
    for text, ids in zip(ODD, ENCODERS[path].encode(ODD)):
        assert np.frombuffer(ids, "<u4").tolist() == LIBRARY[path].encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("path", list(ENCODERS))
@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("aeht \n'sZé9.")), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_same_ids_on_random_text(path, text):
    ids = next(ENCODERS[path].encode([text]))
    assert np.frombuffer(ids, "<u4").tolist() == LIBRARY[path].encode(text, add_special_tokens=False).ids


def test_long_words_take_the_heap_and_agree():
    words = [b"the" * 30, b"abcdefgh" * 9, b"\xff\x00" * 40]
    matrix = {w: ENCODERS[BYTE].merge_block(ENCODERS[BYTE].first_id[np.frombuffer(w, np.uint8)[None, :]])[0] for w in words}
    assert ENCODERS[BYTE].encode_words(words) == matrix


def test_encode_decode_rows(spark):
    docs = spark.createDataFrame([(1, "a b\nc", 7), (1, "a b\nc", 8), (None, None, 9), (2, "", None)], "doc_id long, text string, ids long")
    rows = bpe.encode_decode(docs, BYTE, texts=True).collect()
    assert len(rows) == 4
    for r in rows:
        text = "a b\nc" if r.doc_id == 1 else ""
        ids = np.array(LIBRARY[BYTE].encode(text, add_special_tokens=False).ids, "<u4")
        assert (r.n_tokens, r.ids, r.decoded) == (len(ids), ids.tolist(), text)
        assert r.ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode_decode(docs.limit(0), BYTE).collect() == []


def test_differencing_balances():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 600, 400).tolist()
    parts = packing.differencing(sizes, 16)
    assert sorted(i for p in parts for i in p) == list(range(400))
    loads = [sum(sizes[i] for i in p) for p in parts]
    assert max(loads) - min(loads) < 0.01 * sum(loads) / 16
    assert packing.differencing([], 3) == [[], [], []]


def test_windows_rise_when_capacity_is_exceeded():
    parts = packing.fitted([60, 60, 60], 100)  # 180 tokens would fit two windows by their sum
    assert len(parts) == 3


def test_packing_places_every_token_once(spark):
    texts = [(i, " ".join(f"word{i * j % 97}" for j in range(i * 7))) for i in range(120)]
    rows = [*texts, (None, None), (5, "again the id five"), (500, "long " * 9000), (501, "")]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, length long").repartition(3)
    got = packing.pack(docs, WORD, with_ids=True).collect()
    expected = Counter((d, tuple(LIBRARY[WORD].encode(t or "", add_special_tokens=False).ids) + (2,)) for d, t in rows)
    assert {d for d, _ in expected} == {r.doc_id for r in got}
    by_doc = {}
    for r in got:
        assert r.length == len(r.ids) > 0 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    whole = Counter((d, tuple(x for r in sorted(rs, key=lambda r: r.start) for x in r.ids)) for (d, _), rs in by_doc.items())
    assert whole == expected
    for rs in by_doc.values():
        ends = 0
        for r in sorted(rs, key=lambda r: r.start):
            assert r.start == ends
            ends += r.length
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        ends = 0
        for offset, length in sorted(parts):
            assert offset == ends
            ends += length
        assert ends <= 4096
    total = sum(r.length for r in got)
    assert len(sequences) <= total / 4096 * 1.02 + 3  # at most one window wasted per partition
    assert packing.pack(docs.limit(0), WORD).collect() == []


def test_rollups_equal_a_recount_and_batches_count_once(spark):
    rng = np.random.default_rng(5)
    docs = [(i, f"s{rng.integers(3)}" if i % 7 else None, "en", "v1", int(rng.integers(0, 50))) for i in range(300)]
    frame = spark.createDataFrame(docs, "doc_id long, source string, lang string, version string, tokens long")
    rollup = rollups.TokenRollup(spark, shared_folder(spark))
    assert rollup.totals().collect() == [] and rollup.batches() == []
    assert rollup.commit("b1", rollups.inserts(frame))
    assert not rollup.commit("b1", rollups.inserts(frame))
    gone, changed = frame.where("doc_id % 3 = 0"), frame.where("doc_id % 3 = 1")
    assert rollup.commit("b2", rollups.deletes(gone))
    assert rollup.commit("b3", rollups.revisions(changed, changed.selectExpr("doc_id", "'new' source", "lang", "version", "tokens + 1 tokens")))
    want = Counter()
    for i, source, lang, version, tokens in docs:
        if i % 3:
            key = ("new" if i % 3 == 1 else source, lang, version)
            want[key, "n"] += 1
            want[key, "t"] += tokens + (i % 3 == 1)
    got = rollup.totals().collect()
    assert {(r.source, r.lang, r.version): (r.documents, r.tokens) for r in got} == {k: (want[k, "n"], want[k, "t"]) for k, _ in want}
    assert rollup.commit("b4", rollups.deletes(frame.limit(0))) and rollup.batches() == ["b1", "b2", "b3", "b4"]
    with pytest.raises(ValueError):
        rollup.commit("_x", frame)


def test_counted_has_a_row_per_version(spark):
    from pyspark.sql import functions as F
    docs = spark.createDataFrame([(1, "a b", "s", "l", 3), (2, None, None, None, None)], "doc_id long, text string, source string, lang string, tokens long")
    rows = rollups.counted(docs, {"w": F.regexp_count("text", F.lit("[^ ]+")), "c": F.length("text")}).orderBy("doc_id", "version").collect()
    assert [(r.doc_id, r.version, r.tokens) for r in rows] == [(1, "c", 3), (1, "w", 2), (2, "c", 0), (2, "w", 0)]


def test_tokens_of_real_vocabularies(spark):
    texts = ["It's  a test, isn't it?", None, "", "Größe 1234 – naïve\nzwei", "<|endoftext|> x", "中文 mixed", "a " * 3000]
    docs = spark.createDataFrame([(i, "s" if i % 2 else None, "en", t, "x") for i, t in enumerate(texts)],
                                 "doc_id long, source string, lang string, text string, version string").repartition(2)
    names = {"byte": (bpe.BytePairEncoder, "byte_bpe_50k.json"), "word": (bpe.WordEndEncoder, "word_bpe_49k.json")}
    got = rollups.tokenized(docs, {v: (kind, public_tokenizers.path(f)) for v, (kind, f) in names.items()})
    want = set()
    for version, (_, file) in names.items():
        library = Tokenizer.from_file(public_tokenizers.path(file))
        library.no_truncation()
        want |= {(i, "s" if i % 2 else None, "en", version, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts)}
    assert {tuple(r) for r in got.collect()} == want

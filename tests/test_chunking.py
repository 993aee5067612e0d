import random

import pytest
from hypothesis import given, settings, strategies as st

from folioquery.operators import chunking


def reference_chunks(text, size, overlap, separators=("\n\n", "\n", ". ", " ", "")):
    """Independent derivation on strings: pieces carry their separator in front."""
    sep = next(s for s in separators if s == "" or s in text)
    rest = separators[separators.index(sep) + 1:]
    pieces = list(text) if sep == "" else [p for p in [text.split(sep)[0]] + [sep + p for p in text.split(sep)[1:]] if p]
    out, run = [], []

    def merge():
        window = []
        for piece in run:
            if window and sum(map(len, window)) + len(piece) > size:
                out.append("".join(window))
                while window and (sum(map(len, window)) > overlap or sum(map(len, window)) + len(piece) > size):
                    window.pop(0)
            window.append(piece)
        if window:
            out.append("".join(window))
        run.clear()

    for piece in pieces:
        if len(piece) < size:
            run.append(piece)
        else:
            merge()
            out.extend(reference_chunks(piece, size, overlap, rest) if rest else [piece])
    merge()
    return [c.strip() for c in out if c.strip()]


def test_unbroken_text():
    assert [len(c) for c in chunking.split_text("x" * 2000)] == [1000, 1000, 300]


def test_heading_before_an_oversized_piece():
    text = "## Heading of the section\n\n" + "word " * 300
    assert chunking.split_text(text)[0] == "## Heading of the section"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab. \n", max_size=120), st.integers(2, 20))
def test_same_as_brute_force(text, size):
    overlap = size // 3
    got = chunking.split_text(text, size, overlap)
    assert got == (reference_chunks(text, size, overlap) if text else [])
    assert all(len(c) <= size and c in text for c in got)


def test_longer_random_texts():
    rnd = random.Random(5)
    for _ in range(30):
        text = "".join(rnd.choice(["palabra", " ", ". ", "\n", "\n\n", "larga" * 30, " y "]) for _ in range(400))
        assert chunking.split_text(text, 200, 40) == reference_chunks(text, 200, 40)


def test_chunk_rows(spark):
    docs = spark.createDataFrame([("b", 0, "x" * 2000), ("a", 1, "ñandú " * 400), ("a", 0, ""), ("a", 5, "corto")],
                                 "file_name string, doc_seq long, text string")
    got = chunking.recursive_chunks(docs).orderBy("chunk_key").collect()
    assert [r.text for r in got if r.file_name == "a"] == chunking.split_text("ñandú " * 400) + ["corto"]
    fixed = chunking.fixed_chunks(docs).where("file_name = 'b'").orderBy("chunk_key").collect()
    assert [len(r.text) for r in fixed] == [1000, 1000, 300]


@pytest.mark.parametrize("length,expected", [(0, []), (1, [1]), (1000, [1000]), (1001, [1000, 151]), (1850, [1000, 1000])])
def test_fixed_widths(spark, length, expected):
    docs = spark.createDataFrame([("f", 0, "é" * length)], "file_name string, doc_seq long, text string")
    assert [len(r.text) for r in chunking.fixed_chunks(docs).orderBy("chunk_seq").collect()] == expected


def test_chunk_ids_follow_corpus_order(spark):
    rnd = random.Random(3)
    rows = [(f"f{rnd.randrange(5)}", i, "x" * rnd.randrange(1, 4000)) for i in range(200)]
    chunks = chunking.fixed_chunks(spark.createDataFrame(rows, "file_name string, doc_seq long, text string"))
    got = chunking.with_chunk_id(chunks, block=16).collect()
    ordered = sorted(got, key=lambda r: (r.file_name, r.doc_seq, r.chunk_seq))
    assert [r.chunk_id for r in ordered] == list(range(len(got)))

"""Overlapping chunks of document texts."""

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from folioquery import constants as K
from folioquery.operators.ordering import running_total


def _pack(bounds: Sequence[int], size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Fill chunks greedily from adjacent pieces; bounds[i]..bounds[i + 1] is piece i.

    A full chunk is closed and the next one starts with as many trailing pieces as fit the overlap.
    """
    first, last = 0, len(bounds) - 1
    for i in range(last):
        end = bounds[i + 1]
        if i > first and end - bounds[first] > size:
            yield bounds[first], bounds[i]
            while first < i and (bounds[i] - bounds[first] > overlap or end - bounds[first] > size):
                first += 1
    if first < last:
        yield bounds[first], bounds[last]


def _spans(text: str, start: int, end: int, separators: Sequence[str], size: int, overlap: int):
    """Chunk spans of text[start:end], split at the coarsest separator that occurs in it."""
    while separators and text.find(separators[0], start, end) < 0:
        separators = separators[1:]
    if not separators:
        yield from _pack(range(start, end + 1), size, overlap)
        return
    bounds, mark = [start], text.find(separators[0], start, end)
    while mark >= 0:
        if mark > start:
            bounds.append(mark)
        mark = text.find(separators[0], mark + len(separators[0]), end)
    bounds.append(end)

    run = [start]
    for left, right in zip(bounds, bounds[1:]):
        if right - left < size:
            run.append(right)
            continue
        yield from _pack(run, size, overlap)
        yield from _spans(text, left, right, separators[1:], size, overlap)
        run = [right]
    yield from _pack(run, size, overlap)


def split_text(text: str, size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP,
               separators: Sequence[str] = K.SEPARATORS) -> list[str]:
    """Recursive chunks of one text, stripped, empty ones left out."""
    pieces = (text[a:b].strip() for a, b in _spans(text, 0, len(text), separators, size, overlap))
    return [piece for piece in pieces if piece]


def recursive_chunks(documents: DataFrame, size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP) -> DataFrame:
    """Chunks along blank lines, lines, sentences and words; keeps all document columns.

    Greedy filling with overlap is sequential in the text, so it runs as an Arrow-batched function over
    the text column; rows stay where they are and nothing shuffles.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than the chunk size")

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: split_text(t, size, overlap) if t else [])

    return _explode_chunks(documents, split(F.col("text")))


def fixed_chunks(documents: DataFrame, size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP) -> DataFrame:
    """Chunks of a fixed width, each starting ``size - overlap`` characters after the one before.

    The text is cut once into steps; a chunk is its step and the head of what follows, which stays linear
    in the length of the text, and a last step that the chunk before already covers is left out.
    """
    step = size - overlap
    if not 0 <= overlap <= step:
        raise ValueError("overlap must not exceed half the chunk size")
    text = F.col("text")
    steps = documents.withColumn("_steps", F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0)))
    count = F.size("_steps")
    covered = (count > 1) & (F.length(F.element_at("_steps", -1)) <= overlap)
    whole = F.when(count == 0, F.array().cast("array<string>")).otherwise(
        F.slice("_steps", 1, F.greatest(F.lit(1), count - covered.cast("int"))))
    pieces = F.transform(whole, lambda piece, i: F.concat(
        piece, F.coalesce(F.substring(F.get("_steps", i + 1), 1, overlap), F.lit(""))))
    return _explode_chunks(steps, pieces).drop("_steps")


def _explode_chunks(documents: DataFrame, pieces: Column) -> DataFrame:
    kept = [c for c in documents.columns if c != "text"]
    # The outer form keeps Spark from also filtering on the array, which would compute it twice.
    chunks = documents.select(*kept, F.posexplode_outer(pieces).alias("chunk_seq", "text")).where("text IS NOT NULL")
    return chunks.withColumn("chunk_key", chunk_key(F.col("file_name"), F.col("doc_seq"), F.col("chunk_seq")))


def chunk_key(file_name: Column, doc_seq: Column, chunk_seq: Column) -> Column:
    """Identity of a chunk as text that sorts in corpus order."""
    return F.format_string("%s#%010d#%06d", file_name, doc_seq.cast("long"), chunk_seq.cast("int"))


def with_chunk_id(chunks: DataFrame, block: int = 4096) -> DataFrame:
    """Number the chunks 0..n-1 in corpus order (file, document, chunk).

    Only counts are ordered: documents are summed in blocks of ``block`` neighbours, so that neither a
    huge file nor the whole corpus has to pass through one sorted task.
    """
    key, part = ["file_name", "doc_seq"], F.floor(F.col("doc_seq") / block).alias("part")
    sizes = chunks.groupBy(*key).agg(F.count("*").alias("n")).select("*", part)
    blocks = running_total(sizes.groupBy("file_name", "part").agg(F.sum("n").alias("n")),
                           ["file_name", "part"], "n", "before")
    inside = W.partitionBy("file_name", "part").orderBy("doc_seq").rowsBetween(W.unboundedPreceding, -1)
    starts = (sizes.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
              .join(blocks.select("file_name", "part", "before"), ["file_name", "part"])
              .select(*key, (F.col("before") + F.col("inside")).alias("start")))
    return (chunks.join(starts, key)
            .withColumn("chunk_id", F.col("start") + F.col("chunk_seq")).drop("start"))

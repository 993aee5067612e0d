"""Corpus pipeline: documents are filtered, freed of repeats and packed, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor kept. A stage's rows are written as
Parquet and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioquery.llm import lines, minhash, packing, suffixes, toxicity
from folioquery.llm.common import written
from folioquery.llm.queries import table, tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold stay; the label rows of the folder train the classifier."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs are cut out of the texts: three lines, or fewer that hold 50 words.

    A document all of whose lines go stays as a row with an empty text: near dedup links it with nothing, and packing
    gives it its end id alone."""
    return lines.without_repeated_lines(docs, texts=True, words=lines.WORDS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, on shingles of five words at a similarity of 0.8 or more."""
    return minhash.without_near_duplicates(docs, width=5, percent=80)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words covered by a string of 50 words that also starts elsewhere are cut out of the texts, in all its places.

    The stage measures passages in words, as they often have fewer than the 400 bytes that op7_suffixes asks for."""
    return suffixes.without_repeats(docs, texts=True, words=suffixes.LEAST_WORDS)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_repeated_lines), ("near dedup", drop_near_duplicates),
          ("suffix dedup", drop_repeated_passages), ("packing", pack_windows)]
ORACLE_SQL = None  # scoring, signatures and tokenising have no SQL form; the tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

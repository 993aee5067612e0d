"""Registered queries of the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioquery.llm import bpe, centroids, hamming, lines, minhash, nndescent, packing, phrases, quality, rollups, suffixes, toxicity, urls
from folioquery.llm.common import shared_folder, written

URL_RULES = [urls.Rule(*x) for x in (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
                                     ("allow", "com/fr/"), ("block", "com/de/"))]
Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_quality(spark, sf):
    return quality.quality_scores(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op2_toxicity(spark, sf):
    return toxicity.toxicity_scores(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op3_bpe(spark, sf):
    return bpe.encode_decode(table(spark, sf, "documents"), tokenizer("byte_bpe_50k.json"))


def op4_lines(spark, sf):
    return lines.without_repeated_lines(table(spark, sf, "documents"))


def op4_passages(spark, sf):
    """As op4_lines, and runs of one or two lines that hold 50 words or more."""
    return lines.without_repeated_lines(table(spark, sf, "documents"), words=lines.WORDS)


def op5_neighbours(spark, sf):
    return nndescent.nearest(table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op6_hamming(spark, sf):
    codes = written(hamming.sign_codes(table(spark, sf, "embeddings"), "vec_id", "embedding"))
    found = hamming.nearest(codes, codes.where("id % 50 = 0"), k=10)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "distance")


def op7_suffixes(spark, sf):
    return suffixes.without_repeats(table(spark, sf, "documents"))


def op8_minhash(spark, sf):
    return minhash.near_duplicates(table(spark, sf, "documents"))


def op9_packing(spark, sf):
    return packing.pack(table(spark, sf, "documents"), tokenizer("word_bpe_49k.json"))


def op10_token_counts(spark, sf):
    """Two versions of word counts: all documents enter, junk is withdrawn, and the first version is counted anew."""
    docs = table(spark, sf, "documents")
    counts = written(rollups.counted(docs, {
        "words-1": F.regexp_count("text", F.lit("[^ \t\n\r]+")), "words-2": F.regexp_count("text", F.lit("[\\p{L}]+|[^\\p{L} \t\n\r]")),
        "words-1 anew": F.regexp_count("text", F.lit("[^ \t\n\r|]+"))}))
    first, anew = counts.where("version <> 'words-1 anew'"), counts.where("version = 'words-1 anew'").withColumn("version", F.lit("words-1"))
    junk = table(spark, sf, "labels").where("quality = 0").select("doc_id").distinct()
    left = counts.where("version = 'words-1'").join(junk, "doc_id", "left_anti")
    rollup = rollups.TokenRollup(spark, shared_folder(spark))
    rollup.commit("0001", rollups.inserts(first))
    rollup.commit("0002", rollups.deletes(first.join(junk, "doc_id", "left_semi")))
    rollup.commit("0002", rollups.deletes(first))  # a batch sent twice changes nothing
    rollup.commit("0003", rollups.revisions(left, anew.join(junk, "doc_id", "left_anti")))
    return rollup.totals()


def op11_urls(spark, sf):
    return urls.judged_urls(table(spark, sf, "pages"), URL_RULES)


def op12_phrases(spark, sf):
    return phrases.collocations(table(spark, sf, "documents"))


def op13_centroids(spark, sf):
    return centroids.clustered(table(spark, sf, "embeddings"))


def op10_tokenizer_counts(spark, sf):
    """Token counts of two real vocabularies: all documents enter, and those labelled as junk are withdrawn."""
    docs = table(spark, sf, "documents")
    counts = written(rollups.tokenized(docs, {"byte-bpe-50k": (bpe.BytePairEncoder, tokenizer("byte_bpe_50k.json")),
                                              "word-bpe-49k": (bpe.WordEndEncoder, tokenizer("word_bpe_49k.json"))}))
    junk = table(spark, sf, "labels").where("quality = 0").select("doc_id").distinct()
    rollup = rollups.TokenRollup(spark, shared_folder(spark))
    rollup.commit("0001", rollups.inserts(counts))
    rollup.commit("0002", rollups.deletes(counts.join(junk, "doc_id", "left_semi")))
    rollup.commit("0002", rollups.deletes(counts))  # a batch sent twice changes nothing
    return rollup.totals()


REGISTRY: dict[str, Query] = {f.__name__: f for f in (
    op1_quality, op2_toxicity, op3_bpe, op4_lines, op4_passages, op5_neighbours, op6_hamming, op7_suffixes, op8_minhash, op9_packing, op10_token_counts, op10_tokenizer_counts, op11_urls, op12_phrases, op13_centroids)}

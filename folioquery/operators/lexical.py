"""Lexical vectors (tf-idf, unit length) and exact thresholded top-k search over them."""

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from folioquery import constants as K
from folioquery.functions.text import has_word, tokens
from folioquery.functions.vectors import score
from folioquery.operators.products import best_pairs
from folioquery.session import written


class LexicalIndex(NamedTuple):
    total: DataFrame    # n, the number of chunks
    stats: DataFrame    # term, df
    vectors: DataFrame  # vector, category, first_key, keys, counts


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _run_lengths(words: pd.Series) -> pd.Series:
    return words.map(lambda ws: list(Counter(ws).values()))


def term_counts(df: DataFrame, text: str = "text", name: str = "counts") -> DataFrame:
    """Add the (term, tf) pairs of a text in term order, counted inside the row.

    Counting repeated words has no array function: an Arrow batch counter over the tokens was measured
    four times faster than exploding and grouping, and needs no shuffle.
    """
    words = df.withColumn("_words", F.sort_array(tokens(F.col(text))))
    counts = F.arrays_zip(F.array_distinct("_words").alias("term"), _run_lengths(F.col("_words")).alias("tf"))
    return words.withColumn(name, counts).drop("_words")


def _bag(counts: Column) -> Column:
    """Digest of a bag of words; texts with equal bags have equal vectors."""
    spelled = F.array_join(F.transform(counts, lambda c: F.concat(c["term"], F.lit(":"), c["tf"].cast("string"))), " ")
    # Never NULL, and known to be so: otherwise every join on it first filters on it, which would count the
    # words of each text a second time.
    return F.coalesce(F.unhex(F.sha2(spelled, 256)), F.lit(b""))


def term_stats(counted: DataFrame) -> DataFrame:
    """Document frequency per term."""
    terms = counted.select(F.explode_outer("counts.term").alias("term")).where("term IS NOT NULL")
    return terms.groupBy("term").agg(F.count("*").alias("df"))


def _weighted(bags: DataFrame, keys: list[str], total: DataFrame, stats: DataFrame) -> DataFrame:
    """(keys, counts) -> (keys, terms, weights): unit vectors with the rarest terms first."""
    df = F.coalesce("df", F.lit(0))
    idf = F.log((1 + total.scalar()) / (1 + df).cast("double")) + 1
    postings = (bags.select(*keys, F.inline_outer("counts"))
                .join(stats, "term", "left")
                .select(*keys, F.struct(df.alias("df"), "term", (F.col("tf") * idf).alias("w")).alias("p")))
    # The norm is an aggregate of its own: a projected column used inside a lambda would be computed again
    # for every element.
    rows = postings.groupBy(*keys).agg(F.sort_array(F.collect_list("p")).alias("ps"),
                                       F.sum(F.col("p.w") * F.col("p.w")).alias("mass"))
    return rows.select(*keys, F.col("ps.term").alias("terms"),
                       F.transform("ps.w", lambda w: w / F.sqrt("mass")).alias("weights"))


def lexical_index(chunks: DataFrame, k: int = K.TOP_K) -> LexicalIndex:
    """Vectors for (chunk_key, category, text) rows, or for rows that already carry ``counts``.

    Copies collapse to one vector per (bag of words, category); of their keys the first ``k`` are kept,
    as no more than that can appear among the k best. Spark cuts each group to k before the shuffle, so a
    text that fills a third of the corpus costs its task nothing extra.
    """
    if "counts" in chunks.columns:
        counted, worded = chunks, F.size("counts") > 0
    else:
        counted, worded = term_counts(chunks.select("chunk_key", "category", "text")), has_word(F.col("text"))
    # Counted from the input rows: the count needs neither the terms nor the texts.
    total, stats = written(chunks.select(F.count("*").alias("n"))), written(term_stats(counted))

    group = ["bag", "category"]
    in_order = W.partitionBy(*group).orderBy("chunk_key")
    keys = F.collect_list("chunk_key").over(in_order.rowsBetween(W.currentRow, k - 1))
    firsts = (counted.where(worded)
              .select("chunk_key", F.coalesce("category", F.lit("")).alias("category"), "counts")
              .withColumn("bag", _bag(F.col("counts")))
              .withColumn("n", F.row_number().over(in_order)).where(F.col("n") <= k)
              .withColumn("keys", keys).where("n = 1"))
    # Raw counts: weights are made for the few vectors that a question may find.
    return LexicalIndex(total, stats, written(firsts.select(
        F.monotonically_increasing_id().alias("vector"), "category", F.col("chunk_key").alias("first_key"), "keys", "counts")))


def save_lexical_index(index: LexicalIndex, path: str) -> None:
    for name, table in index._asdict().items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def load_lexical_index(spark: SparkSession, path: str) -> LexicalIndex:
    return LexicalIndex(*[spark.read.parquet(f"{path}/{name}") for name in LexicalIndex._fields])


FREQUENT_TERMS = 1 << 16  # terms whose frequencies are sent to the tasks; results do not depend on it


def _with_least_length(vectors: DataFrame, total: DataFrame, stats: DataFrame) -> DataFrame:
    """Add ``least``, at most the length of the weighted vector, without moving a posting: the weights of the most frequent
    terms are known in every task, and each rarer term weighs at least as much as the last one of these."""
    n = total.first().n
    frequent = stats.orderBy(F.desc("df"), "term").limit(FREQUENT_TERMS).collect()
    idf = lambda df: math.log((1 + n) / (1 + df)) + 1
    rarer = idf(frequent[-1].df) if frequent else 1.0
    shared = vectors.sparkSession.sparkContext.broadcast({r.term: idf(r.df) for r in frequent})

    def lengths(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known = shared.value
        for terms, tfs in batches:
            yield pd.Series([math.sqrt(sum((tf * known.get(t, rarer)) ** 2 for t, tf in zip(ts, ns))) for ts, ns in zip(terms, tfs)],
                            dtype=float)

    least = F.pandas_udf(lengths, T.DoubleType())
    return vectors.withColumn("least", least("counts.term", "counts.tf") * (1 - 1e-9))


# Share of the threshold that the skipped tail of a question may reach: more skips more frequent terms,
# less leaves fewer pairs to verify. Results do not depend on it.
_TAIL_SHARE = 0.8

# Pairs of a question's term and a posting, for each posting and for each pair of vectors, from which on vectors are multiplied
# block by block instead of adding up these pairs.
BLOCK_POSTINGS, BLOCK_CELLS = 4.0, 0.1


def _split_tail(vectors: DataFrame, threshold: float) -> DataFrame:
    """Add ``kept``, the number of leading (rarest) terms to search by, and ``tail``, the norm of the rest.

    By Cauchy-Schwarz the terms of the tail add at most its norm to any score. Frequent terms are light
    and come last, so they end up in the tail and never have to pair up rows.
    """
    limit = (_TAIL_SHARE * max(threshold, 0.0)) ** 2
    tail = F.aggregate(
        F.reverse("weights"), F.struct(F.lit(0.0).alias("mass"), F.lit(0.0).alias("cut"), F.lit(0).alias("n")),
        lambda acc, w: F.struct(
            (acc["mass"] + w * w).alias("mass"),
            F.when(acc["mass"] + w * w < limit, acc["mass"] + w * w).otherwise(acc["cut"]).alias("cut"),
            (acc["n"] + (acc["mass"] + w * w < limit).cast("int")).alias("n")))
    return vectors.withColumn("_tail", tail).select(
        *vectors.columns, (F.size("terms") - F.col("_tail.n")).alias("kept"), F.sqrt("_tail.cut").alias("tail"))


def _meets_most(asked_terms: DataFrame, ask_vectors: DataFrame, index: LexicalIndex) -> bool:
    """Whether the questions' terms make so many pairs with the postings that multiplying all vectors is less work. Results
    do not depend on it."""
    count = lambda df, what: df.agg(F.coalesce(what, F.lit(0)).alias("n")).first().n
    pairs, postings = (count(df, F.sum("df")) for df in (asked_terms, index.stats))
    return pairs > BLOCK_POSTINGS * postings and pairs > BLOCK_CELLS * ask_vectors.count() * index.vectors.count()


def _sharing(asked_terms: DataFrame, index: LexicalIndex, floor: float) -> DataFrame:
    """(asking, vector) of the pairs whose postings that meet, and the most the skipped terms can add, reach ``floor``."""
    postings = _with_least_length(index.vectors.select("vector", "category", "counts"), index.total, index.stats).select(
        "vector", "category", "least", F.inline("counts"))
    return (postings.join(asked_terms, "term")
            .where((F.col("only") == "") | (F.col("only") == F.col("category")))
            .groupBy("asking", "vector")
            .agg(F.sum(F.col("tf") * F.col("gain") / F.col("least")).alias("partial"), F.max("tail").alias("tail"))
            .where(F.col("partial") + F.col("tail") >= floor).select("asking", "vector"))


def lexical_topk(questions: DataFrame, index: LexicalIndex, k: int = K.TOP_K,
                 threshold: float = K.THRESHOLDS["lexical"]) -> DataFrame:
    """Best k chunks per question: (question_id, rank, score, chunk_key).

    questions: (question_id, question, category); an empty or NULL category searches everything.
    The question's rare terms are joined with the postings and summed to a partial score, over a length that
    a vector has at least. A pair goes on only if that sum plus the most the skipped terms can add reaches the
    threshold; then its two vectors give the full score, and the winners open up into their copies. No pair
    above the threshold is lost. Only postings of the questions' terms and vectors of such pairs are moved. Where that would
    make far more pairs than there are postings, vectors are multiplied block by block instead (``products``).
    """
    asked = term_counts(questions.select(
        "question_id", "question", F.coalesce("category", F.lit("")).alias("only")), "question")
    asked = asked.where(has_word(F.col("question"))).withColumn("ask", _bag(F.col("counts")))
    asks = asked.select("ask", "only", "counts").dropDuplicates(["ask", "only"])
    ask_vectors = written(_split_tail(_weighted(asks, ["ask", "only"], index.total, index.stats), threshold)
                          .withColumn("asking", F.monotonically_increasing_id()))

    # Tables written down have a known size, so that a few questions are sent to the postings, and not the other way round.
    idf = F.log((1 + index.total.scalar()) / (1 + F.col("df")).cast("double")) + 1
    asked_terms = written(
        ask_vectors.select("asking", "only", "tail", F.explode(F.arrays_zip(
            F.slice("terms", F.lit(1), F.col("kept")).alias("term"), F.slice("weights", F.lit(1), F.col("kept")).alias("w"))).alias("p"))
        .select("asking", "only", "tail", F.col("p.term").alias("term"), F.col("p.w").alias("ask_w"))
        .join(index.stats, "term").withColumn("gain", F.col("ask_w") * idf).drop("ask_w"))
    floor = threshold - 10.0 ** -K.SCORE_DIGITS
    if _meets_most(asked_terms, ask_vectors, index):
        pairs = written(best_pairs(ask_vectors, index.vectors, index.total, index.stats, k, floor))
    else:
        pairs = written(_sharing(asked_terms, index, floor))

    wanted = ask_vectors.select("asking", F.map_from_arrays("terms", "weights").alias("wanted"))
    product = F.aggregate(
        F.zip_with("terms", "weights", lambda t, w: F.coalesce(F.try_element_at("wanted", t), F.lit(0.0)) * w),
        F.lit(0.0), lambda acc, p: acc + p)
    found = index.vectors.select("vector", "first_key", "counts").join(pairs.select("vector").distinct(), "vector", "left_semi")
    scored = (pairs.join(_weighted(found, ["vector", "first_key"], index.total, index.stats), "vector").join(wanted, "asking")
              .select("asking", "vector", "first_key", score(product).alias("score")))

    per_ask = W.partitionBy("asking")
    # The threshold follows the rank: as the score is the sort key the result is the same, and a filter in
    # front would compute the product twice.
    best = (scored.withColumn("rank", F.row_number().over(per_ask.orderBy(F.desc("score"), "first_key")))
            .where((F.col("rank") <= k) & (F.col("score") >= threshold)).drop("rank"))
    opened = written(best).join(index.vectors.select("vector", "keys"), "vector").select(
        "asking", "score", F.explode("keys").alias("chunk_key"))
    ranked = (opened.withColumn("rank", F.row_number().over(per_ask.orderBy(F.desc("score"), "chunk_key")))
              .where(F.col("rank") <= k))
    return (asked.select("question_id", "ask", "only").join(ask_vectors.select("ask", "only", "asking"), ["ask", "only"])
            .join(ranked, "asking").select("question_id", "rank", "score", "chunk_key"))


def hits_with_text(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Attach chunk text and metadata to the few winners; written down, they are seen to be few and texts stay where they are."""
    return written(hits).join(chunks.drop("counts", "vector"), "chunk_key")

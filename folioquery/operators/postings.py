"""A lexical search index that follows single files, with postings in blocks ordered by impact.

Nothing stored depends on the rest of the corpus, so a replaced file costs its own buckets only:

* ``terms``: signed document frequencies, one delta per commit, added up when they are read; the NULL term counts chunks;
* ``vectors``: raw word counts, one row per bag of words and category of a bucket, with the keys of its first copies;
* ``blocks``: postings of a bucket. The impact of a term in a vector is its count over the length of the count vector.
  As no inverse document frequency is below one, the weight of the term is at most that impact times its own frequency
  weight, whatever the corpus. Postings of a term are cut into blocks in descending impact, each with its highest one.

A search gives each term of a question a share of most of the score to reach. A chunk that reaches the score gets at least
the share from one of its terms, so only postings whose impact allows for the share are looked at, and blocks below it are
not opened. Shares grow with the length of a posting list. Opened postings are added up per question and chunk; with the
most that closed ones can add, few pairs can reach the score, and only these are scored in full, so the result is exact.
The first pass asks for a high score; the second one for the k-th best score found so far, or the threshold.
"""

from bisect import insort
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from folioquery import constants as K
from folioquery.functions.text import has_word, tokens
from folioquery.functions.vectors import score
from folioquery.operators.generations import Draft, generation, rows as generation_rows
from folioquery.operators.index import CHUNKS
from folioquery.operators.lexical import _bag, _weighted, _with_least_length, term_counts
from folioquery.session import read_in_parts, written

TERMS, VECTORS, BLOCKS = "search_terms", "search_vectors", "search_blocks"
SEARCH = "search"
REFLECTED = f"{CHUNKS}@{SEARCH}"    # the chunks that the search tables were made from
TERM_BUCKETS = 16
DELTAS = 16             # deltas of the term counts that are added up by readers before a commit folds them
BLOCK_ROWS = 256
SHARD_ROWS = 16 << 10   # chunks of a bucket that one task makes vectors of
SORTED_BYTES = 8 << 20  # vectors on disk whose postings a task sorts
FIRST_SCORE = 0.7       # score the first pass looks for; results do not depend on it
UNOPENED = 0.8          # share of the score that postings left closed may add; results do not depend on it
SLACK = 1e-9            # bounds are widened by this share
_BETWEEN = "\x01"       # no term holds it


class SearchIndex(NamedTuple):
    terms: DataFrame    # term, df; the NULL term counts chunks
    vectors: DataFrame  # bucket, first_key, category, keys, counts
    blocks: DataFrame   # bucket, term, category, top, keys, impacts


# -- writing -----------------------------------------------------------------------------------------------------------
def term_deltas(chunks: DataFrame, sign: int = 1) -> DataFrame:
    """(term, df) of chunks with word ``counts`` or a text, and their number for the NULL term, all times ``sign``."""
    said = F.col("counts.term") if "counts" in chunks.columns else F.array_distinct(tokens(F.col("text")))
    # The outer form keeps Spark from also filtering on the array, which would make it twice.
    words = chunks.select(F.explode_outer(said).alias("term")).where("term IS NOT NULL")
    number = chunks.select(F.lit(None).cast("string").alias("term"))
    return words.unionByName(number).groupBy("term").agg((F.count("*") * sign).alias("df"))


def bucket_vectors(chunks: DataFrame, k: int = K.TOP_K) -> DataFrame:
    """One row per bag of words and category of a bucket; of the keys of its copies the first ``k`` are kept, as no more
    can be among the k best."""
    if "counts" in chunks.columns:
        counted = chunks.where(F.size("counts") > 0)
    else:
        counted = term_counts(chunks.where(has_word(F.col("text"))).select("bucket", "chunk_key", "category", "text"))
    # Counts are moved once, as two strings, which take a third of an array of structs.
    said = [F.array_join("counts.term", _BETWEEN).alias("terms"), F.array_join(F.col("counts.tf").cast("array<string>"), " ").alias("tfs")]
    rows = counted.select("bucket", "chunk_key", F.coalesce("category", F.lit("")).alias("category"), *said, _bag(F.col("counts")).alias("bag"))
    sizes = {row.bucket: row["count"] for row in chunks.groupBy("bucket").count().collect()}  # a number per bucket
    shards = {b: -(-n // SHARD_ROWS) for b, n in sizes.items()} or {0: 1}
    of_bucket = F.element_at(F.create_map(*[F.lit(x) for pair in shards.items() for x in pair]), F.col("bucket"))
    placed = (_few_copies(rows, k).withColumn("shard", F.pmod(F.xxhash64("bag"), of_bucket.cast("long")))
              .repartition(sum(shards.values()), "bucket", "shard"))
    in_order = W.partitionBy("bucket", "shard", "bag", "category").orderBy("chunk_key")
    keys = F.collect_list("chunk_key").over(in_order.rowsBetween(W.currentRow, k - 1))
    counts = F.arrays_zip(F.split("terms", _BETWEEN).alias("term"), F.split("tfs", " ").cast("array<int>").alias("tf"))
    return (placed.withColumn("n", F.row_number().over(in_order)).where(F.col("n") <= k)
            .withColumn("keys", keys).where("n = 1")
            .select("bucket", F.col("chunk_key").alias("first_key"), "category", "keys", counts.alias("counts")))


def _few_copies(rows: DataFrame, k: int) -> DataFrame:
    """Rows but those with ``k`` copies of smaller keys before them in their task, so that a text that fills a third of the
    corpus does not meet in one task. A row that is among the first ``k`` of its bag stays."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, list[str]] = {}
        for batch in batches:
            kept = []
            for i, (key, *bag) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("chunk_key", "bucket", "category", "bag")])):
                first = seen.setdefault(tuple(bag), [])
                if len(first) < k or key < first[-1]:
                    insort(first, key)
                    del first[k:]
                    kept.append(i)
            yield batch.take(pa.array(kept, pa.int32()))

    return rows.mapInArrow(cut, rows.schema)


def _length(counts: str = "counts") -> Column:
    """Length of a vector of raw counts."""
    return F.sqrt(F.aggregate(f"{counts}.tf", F.lit(0.0), lambda total, tf: total + tf.cast("double") * tf.cast("double")))


def posting_blocks(vectors: DataFrame) -> DataFrame:
    """Postings sorted by bucket, term, category and descending impact, cut into blocks where their vectors are read: no
    posting is shuffled, a frequent term is spread over the tasks like its vectors."""
    # The length is made in a select of its own: beside the generator it would be computed again for every posting.
    postings = (vectors.select("bucket", "category", "first_key", "counts", _length().alias("length"))
                .select("bucket", "category", "first_key", "length", F.inline("counts"))
                .select("bucket", "term", "category", (F.col("tf") / F.col("length")).alias("impact"), "first_key"))
    order = ["term", "bucket", "category", F.desc("impact"), "first_key"]
    schema = T.StructType([vectors.schema["bucket"], T.StructField("term", T.StringType()), T.StructField("category", T.StringType()),
                           T.StructField("top", T.DoubleType()), T.StructField("keys", T.ArrayType(T.StringType())),
                           T.StructField("impacts", T.ArrayType(T.DoubleType()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            fresh = np.zeros(batch.num_rows, dtype=bool)
            fresh[0] = True
            for name in ("bucket", "term", "category"):
                column = batch.column(name)
                fresh[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
            start = np.flatnonzero(fresh)
            place = np.arange(batch.num_rows) - start[np.cumsum(fresh) - 1]
            start = np.flatnonzero(place % BLOCK_ROWS == 0)
            ends = pa.array(np.append(start, batch.num_rows), pa.int32())
            first = batch.take(pa.array(start))
            yield pa.RecordBatch.from_arrays(
                [first.column("bucket"), first.column("term"), first.column("category"), first.column("impact"),
                 pa.ListArray.from_arrays(ends, batch.column("first_key")), pa.ListArray.from_arrays(ends, batch.column("impact"))],
                ["bucket", "term", "category", "top", "keys", "impacts"])

    return postings.sortWithinPartitions(*order).mapInArrow(cut, schema)


def add_to_search(draft: Draft, k: int = K.TOP_K) -> list[int]:
    """Bring the search tables of a draft up to date with its chunks; returns the buckets that were out of date.

    A bucket is out of date if its chunks are not the ones the search tables were made from. Only chunks of these buckets
    are read, in their former and their new state, however many commits lie between the two.
    """
    now, then = draft.seen().parts[CHUNKS], draft.base.parts.get(REFLECTED, {})
    stale = sorted(b for b in now.keys() | then.keys() if now.get(b) != then.get(b))
    anew = not then or len(stale) == len(now.keys() | then.keys())
    if not stale and then:
        return []
    chunks = draft.rows(CHUNKS, stale)
    deltas = term_deltas(chunks)
    if not anew:
        deltas = summed(deltas.unionByName(term_deltas(draft.rows(REFLECTED, stale), -1))).where("df <> 0")
    fold = anew or max(map(len, draft.base.parts[TERMS].values()), default=0) >= DELTAS
    if fold and not anew:
        deltas = summed(deltas.unionByName(draft.rows(TERMS).drop("bucket"))).where("df <> 0")
    replaced = None if anew else stale
    placed = deltas.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(TERM_BUCKETS)).cast("int"))
    draft.write(TERMS, placed, ["term"], None if fold else ())
    draft.write(VECTORS, bucket_vectors(chunks, k), ["first_key"], replaced, together=True)
    # Read back from the files just written: there a bucket has few files, so its blocks are full and need not be gathered.
    # A task sorts the postings of its vectors, many times their size on disk.
    with read_in_parts(draft.spark, SORTED_BYTES):
        draft.write(BLOCKS, posting_blocks(draft.rows(VECTORS, stale)), ["term", "category", F.desc("top")], replaced, together=True)
    draft.remember(CHUNKS, SEARCH, stale)
    return stale


def summed(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy("term").agg(F.sum("df").alias("df"))


def read_search(spark: SparkSession, path: str) -> SearchIndex:
    """The search tables of the newest generation; later commits do not change them."""
    seen = generation(spark, path)
    terms, vectors, blocks = (generation_rows(spark, path, seen, name) for name in (TERMS, VECTORS, BLOCKS))
    return SearchIndex(summed(terms).where("df > 0"), vectors, blocks)


# -- searching ---------------------------------------------------------------------------------------------------------
def _shares(asks: DataFrame, total: DataFrame, stats: DataFrame) -> DataFrame:
    """(asking, only, term, weight, gain, share): the weight of a term in the question, the score it adds at an impact of
    one, at most, and its share of the score."""
    idf = F.log((1 + total.scalar()) / (1 + F.coalesce("df", F.lit(0))).cast("double")) + 1
    per_ask = W.partitionBy("asking")  # the words of one question
    weighed = (asks.select("asking", "only", F.inline("counts")).join(stats, "term", "left")
               .select("asking", "only", "term", F.coalesce("df", F.lit(0)).alias("df"), idf.alias("idf"), (F.col("tf") * idf).alias("w")))
    weight = F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(per_ask))
    return weighed.select("asking", "only", "term", "df", weight.alias("weight"), (weight * F.col("idf")).alias("gain"),
                          (F.sqrt("df") / F.sum(F.sqrt("df")).over(per_ask)).alias("share")).where("df > 0").drop("df")


def _scales(vectors: DataFrame, total: DataFrame, stats: DataFrame) -> DataFrame:
    """(bucket, first_key, scale): an impact times ``scale`` is at least the count over the weighted length of the vector."""
    least = _with_least_length(vectors.select("bucket", "first_key", "counts"), total, stats)
    return least.select("bucket", "first_key", (_length() / F.col("least")).alias("scale"))


def opened_postings(wanted: DataFrame, blocks: DataFrame, below: Column | None = None) -> DataFrame:
    """(term, category, bucket, first_key, impact) of postings with an impact that some question needs, and less than
    the highest ``below``, each once.

    Postings are opened in blocks whose highest impact reaches ``need``; all others are never unfolded."""
    low = wanted.groupBy("term").agg(F.min("need").alias("low"), *([] if below is None else [F.max(below).alias("below")]))
    rows = (blocks.join(low, "term").where(F.col("top") >= F.col("low"))
            .select("term", "category", "bucket", *low.columns[1:], F.explode(F.arrays_zip("keys", "impacts")).alias("posting")))
    enough = F.col("posting.impacts") >= F.col("low")
    if below is not None:
        enough &= F.col("posting.impacts") < F.col("below")
    return rows.where(enough).select("term", "category", "bucket", F.col("posting.keys").alias("first_key"),
                                     F.col("posting.impacts").alias("impact"))


def search(questions: DataFrame, index: SearchIndex, k: int = K.TOP_K, threshold: float = K.THRESHOLDS["lexical"],
           first_score: float = FIRST_SCORE) -> DataFrame:
    """Best k chunks per question: (question_id, rank, score, chunk_key), as ``lexical.lexical_topk`` gives them.

    questions: (question_id, question, category); an empty or NULL category searches everything.
    """
    terms = written(index.terms)
    total = terms.where("term IS NULL").groupBy().agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n"))
    stats = terms.where("term IS NOT NULL")
    asked = term_counts(questions.select(
        "question_id", "question", F.coalesce("category", F.lit("")).alias("only")), "question")
    asked = asked.where(has_word(F.col("question"))).withColumn("ask", _bag(F.col("counts")))
    asks = written(asked.select("ask", "only", "counts").dropDuplicates(["ask", "only"])
                   .withColumn("asking", F.monotonically_increasing_id()))
    per_ask = W.partitionBy("asking")
    # Tables written down have a known size, so that a few questions are sent to the postings, and not the other way round.
    shares = written(_shares(asks, total, stats))
    masses = shares.groupBy("asking").agg(F.sum(F.col("weight") * F.col("weight")).alias("mass"))
    scales = written(_scales(index.vectors, total, stats))
    wanted_map = shares.groupBy("asking").agg(
        F.map_from_entries(F.collect_list(F.struct("term", "weight"))).alias("wanted"))  # the words of one question
    product = F.aggregate(
        F.zip_with("terms", "weights", lambda t, w: F.coalesce(F.try_element_at("wanted", t), F.lit(0.0)) * w),
        F.lit(0.0), lambda acc, p: acc + p)

    def candidates(reach: DataFrame) -> DataFrame:
        """(asking, bucket, first_key) of all pairs that can have a score of ``reach`` (asking, reach).

        What a pair's opened postings add to its score is known, up to the least length of its vector. Every other term
        adds at most what it needs for being opened, and all of them at most the length that is left of the question."""
        floor = F.col("reach") - 10.0 ** -K.SCORE_DIGITS
        limits = written(
            shares.join(reach.join(masses, "asking"), "asking").withColumn("floor", floor)
            .withColumn("most", F.col("share") * F.greatest(F.col("floor"), F.lit(0.0)) * UNOPENED)
            .withColumn("need", F.col("most") / F.col("gain") * (1 - SLACK)))
        # In terms of impacts a posting needs less, as the weighted length of its vector is not known before it is opened.
        postings = opened_postings(limits.select("term", "need"), index.blocks).join(scales, ["bucket", "first_key"])
        weighed = postings.select("term", "category", "bucket", "first_key", (F.col("impact") * F.col("scale")).alias("impact"))
        added = (weighed.join(limits, "term")
                 .where(((F.col("only") == "") | (F.col("only") == F.col("category"))) & (F.col("impact") >= F.col("need")))
                 .groupBy("asking", "bucket", "first_key")
                 .agg(F.sum(F.col("gain") * F.col("impact")).alias("partial"), F.sum("most").alias("known"),
                      F.sum(F.col("weight") * F.col("weight")).alias("seen"), F.first("mass").alias("mass"), F.first("floor").alias("floor")))
        by_need = F.greatest(F.col("floor"), F.lit(0.0)) * UNOPENED - F.col("known")
        by_length = F.sqrt(F.greatest(F.col("mass") - F.col("seen"), F.lit(0.0)))
        rest = F.greatest(F.least(by_need, by_length), F.lit(0.0))
        return written(added.where(F.col("partial") + rest + SLACK >= F.col("floor")).select("asking", "bucket", "first_key"))

    def scored(pairs: DataFrame) -> DataFrame:
        found = index.vectors.join(pairs.select("bucket", "first_key").distinct(), ["bucket", "first_key"], "left_semi")
        weighted = _weighted(found.select("bucket", "first_key", "counts"), ["bucket", "first_key"], total, stats)
        best = (pairs.join(weighted, ["bucket", "first_key"]).join(wanted_map, "asking")
                .select("asking", "bucket", "first_key", score(product).alias("score")))
        return best.where(F.col("score") >= threshold)

    def opened(best: DataFrame) -> DataFrame:
        """The k best with all their copies; a vector stands for at most k."""
        top = (best.withColumn("rank", F.row_number().over(per_ask.orderBy(F.desc("score"), "first_key")))
               .where(F.col("rank") <= k).drop("rank"))
        keys = top.join(index.vectors.select("bucket", "first_key", "keys"), ["bucket", "first_key"]).select(
            "asking", "score", F.explode("keys").alias("chunk_key"))
        return (keys.withColumn("rank", F.row_number().over(per_ask.orderBy(F.desc("score"), "chunk_key")))
                .where(F.col("rank") <= k))

    high = max(threshold, first_score)
    found = opened(scored(candidates(asks.select("asking", F.lit(float(high)).alias("reach")))))
    if high > threshold:
        found = written(found)
        reached = found.where(F.col("rank") == k).select("asking", F.col("score").alias("reach"))
        lower = (asks.select("asking").join(reached, "asking", "left")
                 .withColumn("reach", F.coalesce("reach", F.lit(float(threshold)))).where(F.col("reach") < high))
        lower = written(lower)
        # The second pass finds all that such a question reaches, so nothing of the first one is kept for it.
        found = found.join(lower, "asking", "left_anti").unionByName(opened(scored(candidates(lower))))
    return asked.select("question_id", "ask", "only").join(asks.select("ask", "only", "asking"), ["ask", "only"]).join(
        found, "asking").select("question_id", "rank", "score", "chunk_key")

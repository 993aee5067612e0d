"""The user-level jobs: ingest a folder, re-index files, answer a table of questions."""

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioquery import constants as K
from folioquery.operators import answers as A, chunking, dense, index as I, lexical, postings, reconcile as R
from folioquery.operators.generations import Draft
from folioquery.operators.providers import Embedder, vectorise
from folioquery.session import checkpoint
from folioquery.sources.categories import folder_categories
from folioquery.sources.corpus import load_documents
from folioquery.sources.files import literal_path


def _with_override(spark: SparkSession, paths: str | list[str], options: dict) -> dict:
    """Source options with the category file of each folder read from, unless the caller names an override."""
    if "override" in options:
        return options
    folders = [paths.rstrip("/")] if isinstance(paths, str) else sorted({p.rpartition("/")[0] for p in paths})
    maps = [folder_categories(spark, f"{folder}/{K.CATEGORY_FILE}") for folder in folders if not re.search(r"[*?{]", folder)]
    if not maps:
        return options
    return options | {"override": reduce(DataFrame.unionByName, maps).dropDuplicates(["file_name"])}


def ingest(spark: SparkSession, folder: str | list[str], index_path: str, buckets: int = I.BUCKETS,
           size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP, embed: Embedder | None = None,
           **source_options) -> DataFrame:
    """Read, chunk, vectorise and write the index; returns units and chunks per file.

    Chunk counts are read back from the written index; the corpus is parsed for its units, for the numbering and for
    the write.
    """
    documents = load_documents(spark, folder, **_with_override(spark, folder, source_options))
    chunks = chunking.with_chunk_id(chunking.recursive_chunks(documents, size, overlap))
    draft = Draft(spark, index_path)
    I.build_index(vectorise(chunks, embed), index_path, buckets=buckets, draft=draft)
    if embed is None:
        postings.add_to_search(draft)
    draft.publish()
    written = I.read_index(spark, index_path).groupBy("file_name").agg(F.count("*").alias("chunks"))
    return (I.units_per_file(documents).join(written, "file_name", "left")
            .select("file_name", "units", F.coalesce("chunks", F.lit(0)).alias("chunks")))


def reindex(spark: SparkSession, paths: list[str], index_path: str, buckets: int = I.BUCKETS,
            size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP, embed: Embedder | None = None,
            refresh: bool = True, **source_options) -> None:
    """Replace the chunks of the given files. Their chunk_id restarts at 0, as for any batch of its own.

    The search index follows in the same commit, at the cost of the buckets of these files; with ``refresh`` off that is
    left for a later ``refresh_search``, for example after many small batches. Readers go over to chunks and search index
    together.
    """
    documents = load_documents(spark, [literal_path(p) for p in paths], **_with_override(spark, paths, source_options))
    chunks = chunking.with_chunk_id(chunking.recursive_chunks(documents, size, overlap))
    files = spark.createDataFrame([(p.rstrip("/").rsplit("/", 1)[-1],) for p in paths], "file_name string")
    draft = Draft(spark, index_path)
    I.replace_files(spark, index_path, vectorise(chunks, embed), files, buckets, draft)
    if embed is None and refresh:
        postings.add_to_search(draft)
    draft.publish()


def sync(spark: SparkSession, folder: str, index_path: str, buckets: int = I.BUCKETS, size: int = K.CHUNK_SIZE,
         overlap: int = K.CHUNK_OVERLAP, embed: Embedder | None = None, **source_options) -> dict[str, int]:
    """Make the index follow a folder in one commit: new and changed files are read, gone ones leave; counts by state.

    Files are compared by the digest of their contents. A file of an index that was made without digests counts as
    changed once. Only the names of new and changed files reach the driver, as the paths to be read.
    """
    draft = Draft(spark, index_path)
    listing = checkpoint(R.folder_listing(spark, folder))
    if R.FILES in draft.base.schemas:
        known = draft.rows(R.FILES)
    elif I.CHUNKS in draft.base.schemas:
        known = draft.rows(I.CHUNKS).select("file_name").distinct().withColumn("digest", F.lit(None).cast("string"))
    else:
        known = listing.limit(0)
    states = checkpoint(R.reconciled(listing, known))
    counts = {row.state: row.n for row in states.groupBy("state").agg(F.count("*").alias("n")).collect()}
    different = states.where(F.col("state") != R.SAME).select("file_name")
    if not counts.keys() - {R.SAME}:
        return counts
    paths = [row.path for row in listing.join(different, "file_name", "left_semi").select("path").collect()]
    options = _with_override(spark, folder, source_options)
    if paths:
        documents = load_documents(spark, [literal_path(p) for p in paths], **options)
        chunks = vectorise(chunking.with_chunk_id(chunking.recursive_chunks(documents, size, overlap)), embed)
        touched = I.replace_files(spark, index_path, chunks, different, buckets, draft)
    else:
        none = draft.rows(I.CHUNKS).limit(0).drop("bucket")
        touched = I.replace_files(spark, index_path, none, different, buckets, draft)
    named = listing.select("file_name", "digest", I.bucket(F.col("file_name"), buckets).alias("bucket"))
    whole = R.FILES not in draft.base.schemas
    draft.write(R.FILES, named if whole else named.where(F.col("bucket").isin(touched)), ["file_name"], None if whole else touched)
    if embed is None:
        postings.add_to_search(draft)
    draft.publish()
    return counts


def refresh_search(spark: SparkSession, index_path: str) -> None:
    """Bring the search index up to date with all commits since it was last written; reads their buckets only."""
    draft = Draft(spark, index_path)
    if postings.add_to_search(draft):
        draft.publish()


def open_search(spark: SparkSession, index_path: str) -> postings.SearchIndex:
    """The search index as it was last written; ``answer`` takes it as ``index``."""
    return postings.read_search(spark, index_path)


def answer(questions: DataFrame, chunks: DataFrame, index: lexical.LexicalIndex | postings.SearchIndex | None = None,
           history: DataFrame | None = None, k: int = K.TOP_K, threshold: float | None = None,
           embed: Embedder | None = None, provider: str = "local", **prompt_options) -> DataFrame:
    """Search, cite and build the prompt (or the fallback) for every question.

    With an embedder the chunks carry a ``vector`` and scores are vector-store relevances, compared with
    the threshold of ``provider``; without one the search is lexical.
    """
    if embed is None:
        search = postings.search if isinstance(index, postings.SearchIndex) else lexical.lexical_topk
        hits = search(questions, index or lexical.lexical_index(chunks, k), k,
                      K.THRESHOLDS["lexical"] if threshold is None else threshold)
    else:
        hits = dense.dense_topk(vectorise(questions, embed, "question", query=True), chunks, k=k, metric="l2_relevance",
                                threshold=K.THRESHOLDS[provider] if threshold is None else threshold)
    return A.answers(questions, lexical.hits_with_text(hits, chunks), history, **prompt_options)

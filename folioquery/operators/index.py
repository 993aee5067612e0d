"""The chunk index: a Parquet table that is rebuilt as a whole or replaced file by file."""

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioquery.operators.generations import Draft, generation, rows as generation_rows
from folioquery.session import written

BUCKETS = 256
CHUNKS = "chunks"


def bucket(file_name: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(file_name), F.lit(buckets)).cast("int")


def together(documents: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Documents with those of a bucket in few partitions: they are smaller to move than the chunks made of them."""
    return documents.withColumn("bucket", bucket(F.col("file_name"), buckets)).hint("rebalance", "bucket").drop("bucket")


def _write(rows: DataFrame, draft: Draft, replaces: Iterable[int] | None, buckets: int, placed: bool = False) -> None:
    rows = rows.withColumn("bucket", bucket(F.col("file_name"), buckets))
    draft.write(CHUNKS, rows, ["category", "file_name"], replaces, together=placed)


def build_index(chunks: DataFrame, path: str, reset: bool = True, buckets: int = BUCKETS, draft: Draft | None = None,
                placed: bool = False) -> None:
    """Write all chunks; without ``reset`` they are appended, which can duplicate a file.

    With a ``draft`` the rows become part of that commit, else they are published at once. Chunks of documents that lie
    ``together`` are ``placed`` already and not moved."""
    own = draft or Draft(chunks.sparkSession, path)
    _write(chunks, own, None if reset else (), buckets, placed)
    if draft is None:
        own.publish()


def read_index(spark: SparkSession, path: str, category: str | None = None,
               file_name: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Index rows of the newest generation; what is committed later does not change them. A category is filtered in the
    scan, a file also prunes to its bucket."""
    seen, only = generation(spark, path), None
    if file_name:
        only = [spark.range(1).select(bucket(F.lit(file_name), buckets)).first()[0]]
    rows = generation_rows(spark, path, seen, CHUNKS, only)
    if category:
        rows = rows.where(F.col("category") == category)
    if file_name:
        rows = rows.where(F.col("file_name") == file_name)
    return rows.drop("bucket")


def replaced(index: DataFrame, chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Index rows after all chunks of ``files`` were replaced by ``chunks``."""
    kept = index.join(files.select("file_name").distinct(), "file_name", "left_anti")
    return kept.unionByName(chunks, allowMissingColumns=True)


def replace_files(spark: SparkSession, path: str, chunks: DataFrame, files: DataFrame,
                  buckets: int = BUCKETS, draft: Draft | None = None) -> list[int]:
    """Replace the chunks of whole files, including files that have none any more; returns the buckets touched.

    Only the buckets of these files are read and written. Readers see the former rows until all are written and the new
    ones from then on. Of two writers that change one bucket at a time the second one fails (``Overtaken``). With a
    ``draft`` the change becomes part of that commit, else it is published at once.
    """
    # Every file with new chunks counts as replaced: a bucket must never be written without being read.
    filled = chunks.select("file_name").distinct()
    # Written down they are known to be few, so the kept chunks need not be moved to be told apart.
    files = written(files.select("file_name").unionByName(filled).distinct())
    # At most ``buckets`` integers reach the driver; they choose the folders that are read.
    touched = [row.bucket for row in files.select(bucket(F.col("file_name"), buckets).alias("bucket")).distinct().collect()]
    own = draft or Draft(spark, path)
    rows = chunks
    if CHUNKS in own.base.schemas:
        near = own.rows(CHUNKS, touched).where(F.col("bucket").isin(touched)).drop("bucket")
        rows = replaced(near, chunks, files)
    _write(rows, own, touched, buckets)
    if draft is None:
        own.publish()
    return touched


def index_categories(index: DataFrame) -> DataFrame:
    """Distinct non-empty categories in order."""
    return index.select("category").where("category <> ''").distinct().orderBy("category")


def units_per_file(documents: DataFrame) -> DataFrame:
    return documents.groupBy("file_name").agg(F.count("*").alias("units")).orderBy("file_name")


def missing_files(expected: DataFrame, documents: DataFrame) -> DataFrame:
    """Expected file names that gave no document."""
    return expected.select("file_name").subtract(documents.select("file_name"))

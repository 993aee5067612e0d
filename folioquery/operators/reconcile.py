"""What changed between a folder and the index that was made from it."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioquery.sources.files import scan

FILES = "files"
NEW, CHANGED, GONE, SAME = "new", "changed", "gone", "same"


def folder_listing(spark: SparkSession, folder: str | list[str], glob: str | None = None) -> DataFrame:
    """(file_name, path, digest) of the files of a folder; each file is read by one task, for its digest alone."""
    return scan(spark, "binaryFile", folder, glob).select("file_name", "path", F.sha2("content", 256).alias("digest"))


def reconciled(listing: DataFrame, known: DataFrame) -> DataFrame:
    """(file_name, state): new, changed, gone or same, by name and digest.

    listing and known: one row per file with file_name and digest. A NULL digest, as of a file indexed without one, differs
    from all others.
    """
    there, here = listing.select("file_name", F.col("digest").alias("there"), F.lit(1).alias("listed")), \
        known.select("file_name", F.col("digest").alias("here"), F.lit(1).alias("indexed"))
    state = (F.when(F.col("indexed").isNull(), F.lit(NEW)).when(F.col("listed").isNull(), F.lit(GONE))
             .when(F.col("there") == F.col("here"), F.lit(SAME)).otherwise(F.lit(CHANGED)))
    return there.join(here, "file_name", "full_outer").select("file_name", state.alias("state"))

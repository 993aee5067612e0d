"""Shared pieces of the file scans."""

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioquery.schema import DOCUMENTS


def any_case(suffix: str) -> str:
    """Glob that matches a suffix in any case, e.g. ``*.[cC][sS][vV]``."""
    return "*" + "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in suffix)


def literal_path(path: str) -> str:
    """A path whose name is meant as it is: characters of glob patterns are escaped."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def metadata_name() -> Column:
    """Base name of the scanned file; the metadata column holds it URL-encoded."""
    return F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))


def scan(spark: SparkSession, kind: str, paths: str | list[str], glob: str | None, **options) -> DataFrame:
    """Files of one kind with their base name; names starting with ``_`` or ``.`` stay hidden."""
    reader = spark.read.format(kind).options(**options)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(paths).select("*", metadata_name().alias("file_name"))


def whole_texts(spark: SparkSession, paths: str | list[str], glob: str | None) -> DataFrame:
    """One row per text file, line ends normalised, undecodable bytes dropped."""
    text = F.replace(F.make_valid_utf8("value"), F.lit("�"), F.lit(""))
    return scan(spark, "text", paths, glob, wholetext=True).select(
        "file_name", F.regexp_replace(text, r"\r\n?", "\n").alias("content"))


def as_documents(df: DataFrame, fmt: str | Column) -> DataFrame:
    """Fill the documents schema; columns the format does not have become NULL."""
    fmt = F.lit(fmt) if isinstance(fmt, str) else fmt
    df = df.withColumn("format", fmt)
    return df.select([
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in DOCUMENTS
    ])

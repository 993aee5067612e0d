"""Business category of a file: folder override, then configured map, then the default."""

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from folioquery import constants as K

def category_map(spark: SparkSession, mapping: dict[str, str]) -> DataFrame:
    # An Arrow table becomes a local relation, which costs no job when it is joined.
    return spark.createDataFrame(pa.table({"file_name": list(mapping), "category": list(mapping.values())},
                                          pa.schema([("file_name", pa.string()), ("category", pa.string())])))


def folder_categories(spark: SparkSession, path: str) -> DataFrame:
    """Override file of a folder; none gives an empty map.

    Spark's file scans hide names that start with ``_`` even when asked for by name, so this one settings
    file is opened through the file system.
    """
    jvm = spark.sparkContext._jvm
    file = jvm.org.apache.hadoop.fs.Path(path)
    system = file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    text = "{}"
    if system.exists(file):
        stream = system.open(file)
        try:
            text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").removeprefix("\ufeff")
        finally:
            stream.close()
    return spark.createDataFrame(pa.table({"value": [text]})).select(
        F.explode(F.from_json("value", "map<string,string>")).alias("file_name", "category"))


def with_category(documents: DataFrame, configured: DataFrame | None = None,
                  override: DataFrame | None = None) -> DataFrame:
    """Attach the category. Both maps have one row per file name; the planner broadcasts them while small."""
    found = []
    joined = documents.drop("category")
    for name, lookup in (("override_category", override), ("configured_category", configured)):
        if lookup is not None:
            joined = joined.join(lookup.select("file_name", F.col("category").alias(name)), "file_name", "left")
            # An empty override falls through; the configured map counts as it is.
            found.append(F.nullif(F.col(name), F.lit("")) if name == "override_category" else F.col(name))
    joined = joined.withColumn("category", F.coalesce(*found, F.lit(K.DEFAULT_CATEGORY)))
    return joined.select(*documents.columns) if "category" in documents.columns else \
        joined.select(*documents.columns, "category")

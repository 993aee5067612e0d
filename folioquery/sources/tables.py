"""CSV records as sentences, and the price catalogue."""

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from folioquery import constants as K
from folioquery.functions.text import cells_sentence
from folioquery.schema import CATALOGUE
from folioquery.sources.files import as_documents, metadata_name
from folioquery.sources.quoted import quoted_records

_CSV = {"quote": '"', "escape": '"', "encoding": "UTF-8"}


def _widest_header(spark: SparkSession, paths: str | list[str], glob: str | None) -> int:
    """Upper bound of the columns of any header: the separators of a file's first line, or, if a quoted cell of
    it goes on in the next line, those of the whole file."""
    lines = spark.read.text(paths, **({"pathGlobFilter": glob} if glob else {})).select(
        F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("read_order"), "value")

    def times(text, sign: str):
        return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))

    files = lines.groupBy("file_path").agg(
        F.min(F.struct("block", "read_order", times(F.col("value"), ",").alias("first"),
                       (times(F.col("value"), '"') % 2 == 1).alias("goes_on"))).alias("head"),
        F.sum(times(F.col("value"), ",")).alias("all"))
    width = F.when(F.col("head.goes_on"), F.col("all")).otherwise(F.col("head.first")) + 1
    return files.agg(F.max(width)).first()[0] or 1


def csv_cells(spark: SparkSession, paths: str | list[str], glob: str | None = None,
              multi_line: bool = True, whole_files: bool = False) -> DataFrame:
    """Records of CSV files that may all differ in their header, of any width.

    A first pass over the lines finds the widest header; a record wider than that fails the job.

    Returns file_name, row_no (first data record = 2), headers and cells. A large file is read by many tasks and its
    records are numbered per split, then shifted by the counts of earlier splits. With ``multi_line`` a quoted cell may
    hold line breaks; ``whole_files`` leaves such files to Spark's own reader, one task each.
    """
    widest = _widest_header(spark, paths, glob)
    names = [f"c{i}" for i in range(widest + 1)]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    options = _CSV | {"maxColumns": max(20480, widest + 2), "multiLine": multi_line}
    fits = F.when(F.col(names[-1]).isNotNull(), F.raise_error(F.lit(
        f"CSV record with more than the {widest} columns of the widest header"))).otherwise(F.lit(True))
    if multi_line and not whole_files:
        parsed = F.from_csv("record", schema.simpleString()[len("struct<"):-1].replace(":", " "), {k: str(v) for k, v in options.items()})
        numbered = (quoted_records(spark, paths, glob).select("file_path", "file_name", "n", parsed.alias("parsed"))
                    .select("file_path", "file_name", "n", "parsed.*")
                    .select("file_path", "file_name", "n", F.array(*names[:-1]).alias("cells"), fits.alias("fits")).where("fits"))
        heads = numbered.where("n = 1").select("file_path", F.col("cells").alias("names"))  # one row per file
        numbered = numbered.join(heads, "file_path")
    else:
        reader = spark.read.schema(schema).options(header=False, **options)
        if glob:
            reader = reader.option("pathGlobFilter", glob)
        records = reader.csv(paths).select(
            F.col("_metadata.file_path").alias("file_path"),
            metadata_name().alias("file_name"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("read_order"),
            F.array(*names[:-1]).alias("cells"),
            fits.alias("fits"),
        ).where("fits")
        in_block = W.partitionBy("file_path", "block").orderBy("read_order")
        numbered = records.withColumn("n", F.row_number().over(in_block))
        if multi_line:
            numbered = numbered.withColumn("names", F.first("cells").over(in_block))
        else:
            earlier = W.partitionBy("file_path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
            shifts = (records.groupBy("file_path", "block").count()
                      .select("file_path", "block", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("shift")))
            heads = (numbered.where("n = 1 AND block = 0")
                     .select("file_path", F.col("cells").alias("names")))
            numbered = (numbered.join(shifts, ["file_path", "block"]).join(heads, "file_path")
                        .withColumn("n", F.col("n") + F.col("shift")))

    width = F.greatest(F.lit(1), F.array_max(F.transform(
        "names", lambda name, i: F.when(name.isNotNull(), i + 1).otherwise(0))))
    headers = F.transform(F.slice("names", 1, width),
                          lambda name, i: F.coalesce(name, F.concat(F.lit("Unnamed: "), i.cast("string"))))
    cells = F.transform(F.slice("cells", 1, width),
                        lambda cell: F.when(~cell.isin(*K.NULL_CELLS), cell))
    return numbered.where("n > 1").select(
        "file_name", F.col("n").cast("long").alias("row_no"), headers.alias("headers"), cells.alias("cells"))


def csv_documents(spark: SparkSession, paths: str | list[str], glob: str | None = None, **options) -> DataFrame:
    """One document per record. A record without any value stays, with an empty text."""
    records = csv_cells(spark, paths, glob, **options)
    return as_documents(records.select(
        "file_name", "row_no", (F.col("row_no") - 2).alias("doc_seq"),
        cells_sentence(F.col("headers"), F.col("cells")).alias("text")), "csv")


def price_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Price list in file order: all columns as text plus the position ``cat_ord``."""
    rows = spark.read.schema(CATALOGUE).options(header=True, multiLine=True, **_CSV).csv(path)
    order = W.partitionBy("file_path").orderBy("read_order")
    return (rows.select("*", F.col("_metadata.file_path").alias("file_path"),
                        F.monotonically_increasing_id().alias("read_order"))
            .withColumn("cat_ord", F.row_number().over(order).cast("long"))
            .drop("file_path", "read_order"))

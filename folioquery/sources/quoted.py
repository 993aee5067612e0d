"""Records of quoted CSV text, read by many tasks.

Whether a line starts inside a quoted cell depends on all lines before it. Each line is therefore read for both cases and
becomes one of four functions of the state it starts in: keep it, turn it round, or end outside or inside whatever came
before. Such functions compose to functions of the same kind, so a split of a file is one too: states run through the
few splits of each file first and through the lines of each split afterwards, in all splits at once.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from folioquery.sources.files import metadata_name

_PLACE = ["file_path", "block"]


def ends_inside(line: Column, inside: bool) -> Column:
    """Whether a quoted cell is open at the end of a line that starts inside or outside of one.

    A doubled quote changes nothing, wherever it stands, and leaves first. A quote opens a cell only as its first sign.
    """
    rest = F.replace(line, F.lit('""'), F.lit(""))
    if inside:
        # What follows the closing quote belongs to the same cell, so a quote there opens none.
        closes = rest.contains('"')
        return ~closes | _opens(F.regexp_replace(rest, '^[^"]*+"', "x"))
    return _opens(rest)


def _opens(rest: Column) -> Column:
    return F.regexp_replace(rest, '(^|,)"[^"]*+"', "$1x").rlike('(^|,)"')


def _carried(rows: DataFrame, order: W, fixed: Column, turns: Column, start: Column) -> tuple[Column, Column]:
    """State before and after each row: that of the last fixed row, turned round by the rows since.

    ``fixed`` is the state a row ends in whatever came before, or NULL; ``turns`` is 1 for a row that turns it round."""
    upto, before = order.rowsBetween(W.unboundedPreceding, 0), order.rowsBetween(W.unboundedPreceding, -1)
    turned = lambda frame: F.coalesce(F.sum(turns).over(frame), F.lit(0)) % 2
    mark = F.when(fixed.isNotNull(), (fixed.cast("int") + turned(upto)) % 2)
    return tuple((F.coalesce(F.last(mark, ignorenulls=True).over(frame), start.cast("int")) + turned(frame)) % 2 == 1
                 for frame in (before, upto))


def quoted_records(spark: SparkSession, paths: str | list[str], glob: str | None = None) -> DataFrame:
    """(file_path, file_name, n, record): the records of each file, numbered from 1, with the line breaks of their cells.

    Lines end at a line feed, with or without a carriage return before it; empty lines between records do not count.
    Many tasks read a large file. A record stays in the task of its first line unless it goes on in the next split.
    """
    reader = spark.read.option("lineSep", "\n")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    lines = reader.text(paths).select(
        F.col("_metadata.file_path").alias("file_path"), metadata_name().alias("file_name"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    order = W.partitionBy(*_PLACE).orderBy("at")
    first = (F.col("block") == 0) & (F.row_number().over(order) == 1)
    lines = lines.withColumn("value", F.when(first, F.ltrim("value", F.lit("﻿"))).otherwise(F.col("value")))
    shown = F.regexp_replace("value", "\r$", "")
    lines = lines.withColumns({"out": ends_inside(shown, False), "in": ends_inside(shown, True)})
    # NULL where the end depends on the start; then it is kept (out stays outside) or turned round.
    fixed = F.when(F.col("out") == F.col("in"), F.col("out"))
    turns = (F.col("out") & ~F.col("in")).cast("int")
    lines = lines.select(*_PLACE, "file_name", "at", "value", fixed.alias("fixed"), turns.alias("turns"))

    # One row per split: its function, from the last fixed line and the turns behind it.
    _, ended = _carried(lines, order, F.col("fixed"), F.col("turns"), F.lit(False))
    _, ended_in = _carried(lines, order, F.col("fixed"), F.col("turns"), F.lit(True))
    ends = lines.select(*_PLACE, "at", ended.alias("from_out"), ended_in.alias("from_in"))
    splits = ends.groupBy(*_PLACE).agg(F.max_by("from_out", "at").alias("from_out"), F.max_by("from_in", "at").alias("from_in"))
    in_file = W.partitionBy("file_path").orderBy("block")
    split_fixed = F.when(F.col("from_out") == F.col("from_in"), F.col("from_out"))
    split_turns = (F.col("from_out") & ~F.col("from_in")).cast("int")
    starts, _ = _carried(splits, in_file, split_fixed, split_turns, F.lit(False))
    splits = splits.select(*_PLACE, starts.alias("starts_inside"))

    lines = lines.join(splits, _PLACE)
    before, after = _carried(lines, order, F.col("fixed"), F.col("turns"), F.col("starts_inside"))
    lines = lines.withColumns({"goes_on": before, "open": after})
    # An empty line between records is none; a record starts where no cell is open.
    lines = lines.where(F.col("goes_on") | ~F.col("value").isin("", "\r"))
    lines = lines.withColumn("n", F.sum((~F.col("goes_on")).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    counts = lines.groupBy(*_PLACE).agg(F.max("n").alias("records"))
    earlier = in_file.rowsBetween(W.unboundedPreceding, -1)
    shifts = counts.select(*_PLACE, F.coalesce(F.sum("records").over(earlier), F.lit(0)).alias("shift"))

    # Lines of one record and one split meet where they are; only records that go on in another split are moved.
    piece = F.struct("at", "value")
    parts = (lines.groupBy(*_PLACE, "n").agg(
        F.first("file_name").alias("file_name"), F.sort_array(F.collect_list(piece)).alias("lines"),
        F.min_by("goes_on", "at").alias("continues"), F.max_by("open", "at").alias("unfinished"))
        .join(shifts, _PLACE).select(
            "file_path", "file_name", (F.col("n") + F.col("shift")).alias("n"), "block",
            F.array_join("lines.value", "\n").alias("record"), (F.col("continues") | F.col("unfinished")).alias("cut")))
    whole = parts.where(~F.col("cut")).select("file_path", "file_name", "n", "record")
    joined = (parts.where("cut").groupBy("file_path", "file_name", "n")
              .agg(F.sort_array(F.collect_list(F.struct("block", "record"))).alias("parts"))
              .select("file_path", "file_name", "n", F.array_join("parts.record", "\n").alias("record")))
    return whole.unionByName(joined).withColumn("record", F.regexp_replace("record", "\r$", ""))

"""Running totals over a global order without a single-task window."""

from pyspark.sql import DataFrame, Window as W, functions as F

from folioquery.session import checkpoint, shuffle_width


def running_total(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over all rows that come before a row in ``order``.

    Rows are range-partitioned and checkpointed, because two evaluations of a range partitioning may cut
    at different places. Sums run inside each range; only one total per range is ordered globally.
    """
    parts = shuffle_width(df.sparkSession)
    ranged = checkpoint(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))
    before_range = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = (ranged.groupBy("_range").agg(F.sum(value).alias("_sum"))
               .select("_range", F.coalesce(F.sum("_sum").over(before_range), F.lit(0)).alias("_offset")))
    inside = W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    # At most one row per range: the broadcast side is bounded by the number of shuffle partitions.
    return (ranged.withColumn(name, F.coalesce(F.sum(value).over(inside), F.lit(0)))
            .join(F.broadcast(offsets), "_range")
            .withColumn(name, F.col(name) + F.col("_offset")).drop("_range", "_offset"))

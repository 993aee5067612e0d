"""Session settings the jobs expect, and durable cut points for long lineages."""

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """Run-time settings: adaptive plans with skew handling, UTC, Arrow transfer."""
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }.items():
        spark.conf.set(key, value)
    return spark


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _shared(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. Only a local session without it, as in tests, gets one next
    to its warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return folder or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"


def scratch_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, for tables that a job writes and reads again."""
    return f"{_shared(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def shuffles_dropped(spark: SparkSession):
    """Shuffle files of a write inside go when its table is written, not when the driver happens to collect its garbage."""
    return _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def read_in_parts(spark: SparkSession, size: int):
    """Tables that a write inside reads come in parts of at most ``size`` bytes, where their files can be split."""
    name = "spark.sql.files.maxPartitionBytes"
    given = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return _setting(spark, name, str(min(size, given)))


def written(df: DataFrame, **options: int | str) -> DataFrame:
    """``df`` as a table in a scratch folder: made once, compressed, read by columns and of a known size."""
    path = scratch_folder(df.sparkSession)
    with shuffles_dropped(df.sparkSession):
        df.write.options(**{"compression": "zstd"} | options).parquet(path)
    return df.sparkSession.read.parquet(path)


def dropped(table: DataFrame) -> None:
    """Delete the files of a ``written`` table that nothing reads any more."""
    spark = table.sparkSession
    for folder in {file.rpartition("/")[0] for file in table.inputFiles()}:
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if place.getName().startswith("scratch-"):
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder, so that later stages survive lost executors."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(_shared(spark))
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """Share out an input that arrives in fewer partitions than the session works with, such as one small
    file; an input that is already split widely stays as it is, without a shuffle."""
    width = min(shuffle_width(df.sparkSession), df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(width) if df.rdd.getNumPartitions() < width else df

"""Query and feedback logs as JSON lines, and the coverage report over them."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioquery import constants as K
from folioquery.functions.text import utc_stamp
from folioquery.operators.history import feedback_label
from folioquery.schema import FEEDBACK_LOG, QUERY_LOG

_NOW = "current_timestamp()"


def query_log(answered: DataFrame, moment: Column | None = None) -> DataFrame:
    """Log rows from (question, answer, sources, used_retrieval, duration_s)."""
    return answered.select(
        F.col("question").alias("pregunta"), F.col("answer").alias("respuesta"),
        F.transform("sources", lambda s: s["file_name"]).alias("fuentes"),
        F.col("used_retrieval").alias("uso_rag"), F.round("duration_s", 2).alias("duracion_s"),
        utc_stamp(F.expr(_NOW) if moment is None else moment).alias("timestamp"))


def feedback_log(feedback: DataFrame, moment: Column | None = None) -> DataFrame:
    """Log rows from (question, answer, positive)."""
    return feedback.select(
        F.col("question").alias("pregunta"),
        F.substring("answer", 1, K.LOGGED_ANSWER_CHARS).alias("respuesta"),
        feedback_label(F.col("positive")).alias("feedback"),
        utc_stamp(F.expr(_NOW) if moment is None else moment).alias("timestamp"))


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("ignoreNullFields", False).json(path)


def read_query_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUERY_LOG).json(path)


def read_feedback_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FEEDBACK_LOG).json(path)


def elapsed_seconds(start: Column, end: Column) -> Column:
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return micros / F.lit(1e6)


def coverage_report(queries: DataFrame) -> DataFrame:
    """Per day: questions, answered share, uncovered questions and durations (median, 95th percentile)."""
    quantile = lambda share: F.percentile_approx("duracion_s", F.lit(share), F.lit(100000))
    return queries.groupBy(F.to_date("timestamp").alias("day")).agg(
        F.count("*").alias("questions"),
        F.count_if("uso_rag").alias("answered"),
        F.count_if(~F.col("uso_rag")).alias("uncovered"),
        (F.count_if("uso_rag") / F.count("*")).alias("answered_rate"),
        quantile(0.5).alias("median_s"), quantile(0.95).alias("p95_s"))


def feedback_report(feedback: DataFrame) -> DataFrame:
    """Per day: votes and the positive share."""
    positive = F.count_if(F.col("feedback") == K.FEEDBACK_POSITIVE)
    return feedback.groupBy(F.to_date("timestamp").alias("day")).agg(
        F.count("*").alias("votes"), positive.alias("positive"), (positive / F.count("*")).alias("positive_rate"))


def uncovered_questions(queries: DataFrame) -> DataFrame:
    """Questions without support in the corpus and how often they were asked."""
    return queries.where(~F.col("uso_rag")).groupBy("pregunta").agg(F.count("*").alias("times"))


def source_usage(queries: DataFrame) -> DataFrame:
    """How many answers cite each file."""
    return (queries.select(F.explode("fuentes").alias("file_name")).groupBy("file_name")
            .agg(F.count("*").alias("citations")))


# -- durations that merge ----------------------------------------------------------------------------------------------
SKETCH_SIZE = 4096   # a sketch is exact up to this many values; beyond, ranks are within about 0.1 % of all values


def daily_sketches(queries: DataFrame, size: int = SKETCH_SIZE) -> DataFrame:
    """(day, questions, sketch): what is kept of a day's durations, as a quantile sketch. Unlogged durations do not count."""
    return (queries.where("duracion_s IS NOT NULL").groupBy(F.to_date("timestamp").alias("day"))
            .agg(F.count("*").alias("questions"), F.kll_sketch_agg_double("duracion_s", size).alias("sketch")))


def append_sketches(queries: DataFrame, path: str) -> None:
    """Add the sketches of new log rows; the rows need not be read again. A day that is written in several parts has
    several sketches, which merge like those of different days."""
    daily_sketches(queries).write.mode("append").parquet(path)


def merged_durations(sketches: DataFrame, *keys: Column, size: int = SKETCH_SIZE) -> DataFrame:
    """Questions, median and 95th percentile of any grouping of days, from their sketches alone."""
    merged = sketches.groupBy(*keys).agg(F.sum("questions").alias("questions"), F.kll_merge_agg_double("sketch", size).alias("sketch"))
    quantile = lambda share: F.kll_sketch_get_quantile_double("sketch", F.lit(share))
    return merged.withColumns({"median_s": quantile(0.5), "p95_s": quantile(0.95)}).drop("sketch")

"""Windowed counts over the logs. Windows and watermark are an extension: the logs themselves have none."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioquery import constants as K
from folioquery.schema import FEEDBACK_LOG, QUERY_LOG


def query_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(QUERY_LOG).json(path)


def feedback_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(FEEDBACK_LOG).json(path)


def windowed_coverage(queries: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Covered and uncovered questions per tumbling window; works on a stream and on a table."""
    counts = (queries.withWatermark("timestamp", delay).groupBy(F.window("timestamp", width).alias("w"))
              .agg(F.count_if("uso_rag").alias("covered"), F.count_if(~F.col("uso_rag")).alias("uncovered")))
    return counts.select(F.col("w.start").alias("window_start"), "covered", "uncovered")


def windowed_feedback(feedback: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Votes per tumbling window and label."""
    counts = (feedback.withWatermark("timestamp", delay).groupBy(F.window("timestamp", width).alias("w"), "feedback")
              .agg(F.count("*").alias("votes")))
    return counts.select(F.col("w.start").alias("window_start"), "feedback", "votes")


def voted_answers(queries: DataFrame, feedback: DataFrame, within: str = "1 day", delay: str = "10 minutes") -> DataFrame:
    """Each logged answer with its votes: (pregunta, uso_rag, timestamp, positive, negative).

    A vote belongs to the answers of its question and text - cut as the feedback log cuts it - that were given up to
    ``within`` before it. Both logs have a watermark, so a stream forgets an answer when no vote can come any more. An
    answer that was logged twice with one time counts once; a question or answer that is NULL has no votes.
    """
    asked = queries.select("pregunta", F.substring("respuesta", 1, K.LOGGED_ANSWER_CHARS).alias("respuesta"), "uso_rag",
                           "timestamp").withWatermark("timestamp", delay)
    asked = asked.dropDuplicates(["pregunta", "respuesta", "uso_rag", "timestamp"])
    votes = feedback.select(F.col("pregunta").alias("voted_question"), F.col("respuesta").alias("voted_answer"), "feedback",
                            F.col("timestamp").alias("voted")).withWatermark("voted", delay)
    belongs = ((F.col("pregunta") == F.col("voted_question")) & (F.col("respuesta") == F.col("voted_answer"))
               & (F.col("voted") >= F.col("timestamp")) & (F.col("voted") <= F.col("timestamp") + F.expr(f"INTERVAL {within}")))
    return (asked.join(votes, belongs, "left_outer").groupBy("pregunta", "respuesta", "uso_rag", "timestamp")
            .agg(F.count_if(F.col("feedback") == K.FEEDBACK_POSITIVE).alias("positive"),
                 F.count_if(F.col("feedback") == K.FEEDBACK_NEGATIVE).alias("negative")).drop("respuesta"))


def windowed_audit(queries: DataFrame, feedback: DataFrame, width: str = "1 hour", within: str = "1 day",
                   delay: str = "10 minutes") -> DataFrame:
    """Per tumbling window of the answers: covered and uncovered questions, answers with a negative vote, and the votes.

    Works on two streams and on two tables, with the same result once the streams' watermarks have passed.
    """
    answers = voted_answers(queries, feedback, within, delay)
    counts = answers.groupBy(F.window("timestamp", width).alias("w")).agg(
        F.count_if("uso_rag").alias("covered"), F.count_if(~F.col("uso_rag")).alias("uncovered"),
        F.count_if(F.col("negative") > 0).alias("disliked"), F.sum("positive").alias("positive"), F.sum("negative").alias("negative"))
    return counts.select(F.col("w.start").alias("window_start"), "covered", "uncovered", "disliked", "positive", "negative")

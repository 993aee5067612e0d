"""Earlier messages of a conversation."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from folioquery import constants as K


def with_history(conversations: DataFrame, messages: int = K.HISTORY_MESSAGES, block: int = 1000) -> DataFrame:
    """Add ``history``: the last ``messages`` messages before each one, oldest first.

    A conversation is worked on in blocks of ``block`` turn numbers, so that one endless conversation
    does not end up in one task. The messages before a block come from the last few of earlier blocks.
    """
    rows = conversations.withColumn("_block", F.floor(F.col("turn") / block))
    message = F.struct("role", "text")
    in_block = W.partitionBy("conv_id", "_block")
    before = in_block.orderBy("turn").rowsBetween(-messages, -1)

    latest = (rows.withColumn("_n", F.row_number().over(in_block.orderBy(F.desc("turn"))))
              .where(F.col("_n") <= messages).select("conv_id", "_block", "turn", message.alias("m")))
    carried = W.partitionBy("conv_id").orderBy("turn").rowsBetween(-messages, -1)
    first = in_block.orderBy("turn")
    starts = (latest.withColumn("_carry", F.collect_list("m").over(carried))
              .withColumn("_first", F.row_number().over(first))
              .where((F.col("_first") == 1) & (F.size("_carry") > 0))
              .select("conv_id", "_block", "_carry"))

    own = rows.withColumn("_own", F.collect_list(message).over(before)).join(starts, ["conv_id", "_block"], "left")
    return own.withColumn("history", _last(F.concat(
        F.coalesce("_carry", F.array().cast("array<struct<role:string,text:string>>")), F.col("_own")), messages)) \
        .drop("_block", "_own", "_carry")


def _last(items: Column, n: int) -> Column:
    return F.slice(items, F.greatest(F.lit(1), F.size(items) - n + 1), F.lit(n))


def feedback_pairs(conversations: DataFrame) -> DataFrame:
    """Each assistant message with the message directly before it, '' for the first."""
    previous = F.coalesce(F.get("history", F.lit(0))["text"], F.lit(""))
    return (with_history(conversations, 1).where(F.col("role") == "assistant")
            .select("conv_id", "turn", previous.alias("question"), F.col("text").alias("answer")))


def feedback_label(positive: Column) -> Column:
    return F.when(positive, F.lit(K.FEEDBACK_POSITIVE)).otherwise(F.lit(K.FEEDBACK_NEGATIVE))

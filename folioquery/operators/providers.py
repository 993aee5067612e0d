"""What a text is searched by: its words, or a vector from the user's embedding function."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from folioquery.functions.text import as_passage, as_query
from folioquery.operators.lexical import term_counts

Embedder = Callable[[Column], Column]  # text -> array<float>, usually a pandas UDF


def vectorise(df: DataFrame, embed: Embedder | None = None, text: str = "text", query: bool = False) -> DataFrame:
    """Add word ``counts``, or with an embedder the ``vector`` of the text behind its role prefix."""
    if embed is None:
        return term_counts(df, text)
    role = as_query if query else as_passage
    return df.withColumn("vector", embed(role(F.col(text))))

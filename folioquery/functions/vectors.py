"""Vector columns, all in double precision."""

import math

from pyspark.sql import Column, functions as F

from folioquery import constants as K


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def l2_normalise(vector: Column) -> Column:
    """Unit-length vector; a zero vector gives NULL."""
    norm = F.sqrt(F.aggregate(
        vector, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(vector, lambda x: x.cast("double") / norm))


def squared_distance(left: Column, right: Column) -> Column:
    gaps = F.zip_with(left, right, lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(gaps, F.lit(0.0), lambda total, g: total + g * g)


def l2_relevance(left: Column, right: Column) -> Column:
    """Vector-store relevance: 1 - d^2 / sqrt(2) over the squared distance."""
    return 1.0 - squared_distance(left, right) / F.lit(math.sqrt(2.0))


def cosine_to_relevance(cosine: Column) -> Column:
    """The same relevance from the cosine of two unit vectors."""
    return 1.0 - (2.0 - 2.0 * cosine) / F.lit(math.sqrt(2.0))


def relevance_to_cosine(threshold: float) -> float:
    return 1.0 - (1.0 - threshold) * math.sqrt(2.0) / 2.0


def score(value: Column) -> Column:
    """Score at the precision used for ranking."""
    return F.round(value, K.SCORE_DIGITS)

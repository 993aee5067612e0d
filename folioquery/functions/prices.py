"""Price texts such as ``450`` or ``desde 250``."""

from pyspark.sql import Column, functions as F

from folioquery import constants as K
from folioquery.functions.text import strip


def price_is_from(text: Column) -> Column:
    return F.lower(strip(text)).startswith(K.PRICE_FROM)


def price_value(text: Column, strict: bool = False) -> Column:
    """Numeric part; a text that is no number gives NULL, or fails the job when strict."""
    number = strip(F.replace(F.lower(strip(text)), F.lit(K.PRICE_FROM), F.lit("")))
    return number.cast("double") if strict else number.try_cast("double")

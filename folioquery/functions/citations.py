"""Source references: where a fragment comes from."""

from pyspark.sql import Column, functions as F

from folioquery import constants as K


def location_label(page: Column, slide: Column, section: Column, row_no: Column) -> Column:
    """Readable location; the first location that is present wins, a section adds its row."""
    row_label = F.concat(F.lit(K.LABEL_ROW), row_no.cast("string"))
    return F.coalesce(
        F.concat(F.lit(K.LABEL_PAGE), page.cast("string")),
        F.concat(F.lit(K.LABEL_SLIDE), slide.cast("string")),
        F.concat(F.lit(K.LABEL_SECTION + "'"), section, F.lit("'"),
                 F.coalesce(F.concat(F.lit(", "), row_label), F.lit(""))),
        row_label,
        F.lit(""),
    )


def location_value(page: Column, slide: Column, section: Column, row_no: Column) -> Column:
    """Bare location as text; zero and empty values fall through to the next one."""
    return F.coalesce(
        F.nullif(page, F.lit(0)).cast("string"),
        F.nullif(slide, F.lit(0)).cast("string"),
        F.nullif(section, F.lit("")),
        F.nullif(row_no, F.lit(0)).cast("string"),
        F.lit(""),
    )


def fragment(rank: Column, file_name: Column, label: Column, category: Column, text: Column) -> Column:
    """One numbered context fragment with its source header."""
    place = F.when(label != "", F.concat(F.lit(", "), label)).otherwise(F.lit(""))
    return F.concat(
        F.lit("[" + K.LABEL_FRAGMENT), rank.cast("string"),
        F.lit(" — " + K.LABEL_SOURCE), file_name, place,
        F.lit(" — " + K.LABEL_CATEGORY), category, F.lit("]\n"), text,
    )


def source_record(hit: Column) -> Column:
    """Struct shown next to an answer for one hit."""
    return F.struct(
        hit["file_name"].alias("file_name"),
        hit["category"].alias("category"),
        location_value(hit["page"], hit["slide"], hit["section"], hit["row_no"]).alias("location"),
        F.round(hit["score"], 3).alias("score"),
        F.substring(hit["text"], 1, K.EXTRACT_CHARS).alias("extract"),
    )

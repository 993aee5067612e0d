"""Whole-folder scan: one lazy scan per format, then a union by name."""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from folioquery.sources.categories import with_category
from folioquery.sources.files import any_case
from folioquery.sources.html import html_documents
from folioquery.sources.office import office_documents, sheet_sentences, slide_documents, word_sections
from folioquery.sources.sections import Field, entity_documents, keyed_entity_documents, markdown_documents
from folioquery.sources.tables import csv_documents

Loader = Callable[[SparkSession, str | list[str], str | None], DataFrame]


def loaders(fields: list[Field] | None = None, **csv_options) -> dict[str, Loader]:
    """Suffix -> scan. Without the field layout of its entities JSON is read with its keys as labels. Callers may add
    or replace entries.

    Page texts of PDF files come from an extractor of the user's choice through ``page_documents``.
    """
    registry: dict[str, Loader] = {
        ".csv": lambda spark, paths, glob: csv_documents(spark, paths, glob, **csv_options),
        ".md": markdown_documents,
        ".docx": lambda spark, paths, glob: office_documents(spark, paths, glob, word_sections),
        ".xlsx": lambda spark, paths, glob: office_documents(spark, paths, glob, sheet_sentences),
        ".html": html_documents,
        ".htm": html_documents,
        ".pptx": lambda spark, paths, glob: office_documents(spark, paths, glob, slide_documents),
    }
    registry[".json"] = ((lambda spark, paths, glob: entity_documents(spark, paths, fields, glob)) if fields
                         else keyed_entity_documents)
    return registry


def load_documents(spark: SparkSession, paths: str | list[str], registry: dict[str, Loader] | None = None,
                   configured: DataFrame | None = None, override: DataFrame | None = None,
                   extra: DataFrame | None = None) -> DataFrame:
    """All supported files of a folder (not of its sub-folders) or of a list of files.

    ``extra`` takes documents from elsewhere, for example page texts.
    """
    registry = registry or loaders()
    scans = [load(spark, paths, any_case(suffix)) for suffix, load in registry.items()]
    if extra is not None:
        scans.append(extra)
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scans)
    return with_category(union, configured, override)

"""Markdown sections, JSON entities and page texts."""

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from folioquery.functions.text import clean, has_text, section_title
from folioquery.sources.files import as_documents, scan, whole_texts

# (label, field, separator of a list field or None for a plain text field)
Field = tuple[str, str, str | None]


def markdown_sections(texts: DataFrame) -> DataFrame:
    """Split (file_name, content) before every line that starts with ``## ``."""
    parts = F.transform(F.split("content", r"\n(?=## )"), clean)
    units = texts.select("file_name", F.posexplode_outer(F.filter(parts, lambda t: t != "")).alias("doc_seq", "text"))
    return as_documents(units.where("text IS NOT NULL").withColumn("section", section_title(F.col("text"))), "markdown")


def markdown_documents(spark: SparkSession, paths, glob: str | None = None) -> DataFrame:
    return markdown_sections(whole_texts(spark, paths, glob))


def use_case_fields(company: str) -> list[Field]:
    """Layout of the industry use cases; one label and one key carry the company name."""
    return [
        ("Industria", "industria", None),
        ("Problemas típicos", "problemas_tipicos", "; "),
        (f"Solución de {company}", f"solucion_{company.lower()}", None),
        ("Servicios relacionados", "servicios_relacionados", ", "),
        ("Resultado esperado", "resultado_esperado", None),
    ]


def entity_documents(spark: SparkSession, paths, fields: list[Field], glob: str | None = None,
                     array: str = "casos_de_uso", strict: bool = True) -> DataFrame:
    """One labelled paragraph per element of a top-level array; the first field names the section.

    A file without the array gives no rows. An element without one of the fields fails the job when
    ``strict``, otherwise its line is left out.
    """
    element = T.StructType([
        T.StructField(name, T.ArrayType(T.StringType()) if joiner else T.StringType())
        for _, name, joiner in fields])
    schema = T.StructType([T.StructField(array, T.ArrayType(element))])
    contents = scan(spark, "text", paths, glob, wholetext=True)
    parsed = contents.select("file_name", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("json"))
    items = parsed.select("file_name", F.posexplode(f"json.{array}").alias("doc_seq", "e"))

    lines = []
    for label, name, joiner in fields:
        value = F.col(f"e.{name}")
        if strict:
            value = F.when(value.isNull(), F.raise_error(F.lit(f"missing field {name}"))
                           .cast(T.ArrayType(T.StringType()) if joiner else "string")).otherwise(value)
        value = F.array_join(value, joiner) if joiner else value
        lines.append(F.concat(F.lit(f"{label}: "), value, F.lit(".")))
    return as_documents(items.select(
        "file_name", "doc_seq", F.col(f"e.{fields[0][1]}").alias("section"),
        F.concat_ws("\n", *lines).alias("text")), "json")


def keyed_entity_documents(spark: SparkSession, paths, glob: str | None = None, array: str = "casos_de_uso") -> DataFrame:
    """Entities of any layout: a line ``Key: value.`` per field in file order, lists joined by ``; ``.

    The first field names the section; a file without the array gives no rows.
    """
    contents = scan(spark, "text", paths, glob, wholetext=True)
    items = contents.select("file_name", F.posexplode(F.from_json(
        F.get_json_object("value", f"$.{array}"), "array<map<string,string>>")).alias("doc_seq", "e"))

    def line(entry):
        label = F.concat(F.upper(F.substring(entry["key"], 1, 1)), F.replace(F.substring(entry["key"], F.lit(2), F.length(entry["key"])), F.lit("_"), F.lit(" ")))
        listed = F.from_json(entry["value"], "array<string>")
        value = F.when(entry["value"].startswith("["), F.array_join(listed, "; ")).otherwise(entry["value"])
        return F.concat(label, F.lit(": "), F.coalesce(value, F.lit("")), F.lit("."))

    fields = F.map_entries("e")
    return as_documents(items.select(
        "file_name", "doc_seq", F.get(fields, F.lit(0))["value"].alias("section"),
        F.array_join(F.transform(fields, line), "\n").alias("text")), "json")


def page_documents(pages: DataFrame, fmt: str = "pdf") -> DataFrame:
    """Already extracted page texts (file_name, page, text): cleaned, empty pages dropped."""
    units = pages.where(has_text(F.col("text"))).select(
        "file_name", "page", (F.col("page") - 1).alias("doc_seq"), clean(F.col("text")).alias("text"))
    return as_documents(units, fmt)

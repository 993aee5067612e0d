"""Web pages as sections, with column expressions only: every page stays in its row, nothing shuffles."""

import json
from functools import cache
from html.entities import html5

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioquery import constants as K
from folioquery.functions.text import clean, strip
from folioquery.sources.files import as_documents, whole_texts

_HEADING = "|".join(K.HTML_HEADING_TAGS)
_SELECTED = "|".join(K.HTML_HEADING_TAGS + K.HTML_TEXT_TAGS)
_MARKUP = r"(?s)<!--.*?-->|<[^>]+>"
_CUT = "\x01"  # stands for a piece of markup
_REPLACEMENT = 0xFFFD
_OTHER_TAG = rf"<!--.*?-->|<(?!/?(?:{_SELECTED})\b)[^>]*>"


@cache
def _named_references() -> str:
    return json.dumps({f"&{name}": text for name, text in html5.items() if name.endswith(";")})


@cache
def _windows_codes() -> list[int]:
    """What references to 128 ... 159 mean: the characters of the Windows code page at these places."""
    return [ord(bytes([b]).decode("cp1252", "ignore") or chr(b)) for b in range(128, 160)]


def decode_entities(text: Column) -> Column:
    """Named (HTML 5 table of the standard library) and numeric character references.

    References to no character - surrogates, zero, beyond the last code point - become the replacement character.
    """
    names = F.from_json(F.lit(_named_references()), "map<string,string>")

    def numeric(ref: Column, base: int) -> Column:
        digits = F.regexp_extract(ref, r"^&#[xX]?0*([0-9A-Fa-f]*);$", 1)
        number = F.when(F.length(digits) > 7, F.lit(_REPLACEMENT)).otherwise(
            F.coalesce(F.conv(F.when(digits == "", "0").otherwise(digits), base, 10).cast("int"), F.lit(_REPLACEMENT)))
        code = (F.when((number == 0) | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF), F.lit(_REPLACEMENT))
                .when(number.between(128, 159), F.get(F.array(*map(F.lit, _windows_codes())), number - 128))
                .otherwise(number))
        return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")

    def decoded(piece: Column) -> Column:
        return (F.when(piece.rlike(r"^&#[0-9]+;$"), numeric(piece, 10))
                .when(piece.rlike(r"^&#[xX][0-9A-Fa-f]+;$"), numeric(piece, 16))
                .when(piece.rlike(r"^&[A-Za-z0-9]+;$"), F.coalesce(F.try_element_at(names, piece), piece))
                .otherwise(piece))

    pieces = F.split(text, r"(?=&#?[A-Za-z0-9]{1,31};)|(?<=;)")
    return F.when(text.contains("&"), F.array_join(F.transform(pieces, decoded), "")).otherwise(text)


def visible_text(markup: Column) -> Column:
    """Text nodes stripped and joined by one space.

    No pattern repeats a group: Java's matcher recurses on those, which overflows its stack on long runs of tags.
    """
    text = F.regexp_replace(F.regexp_replace(markup, "&nbsp;|&#160;", "\u00a0"), _MARKUP, _CUT)
    nodes = F.filter(F.transform(F.split(text, _CUT), strip), lambda node: node != "")
    return strip(decode_entities(F.array_join(nodes, " ")))


def html_sections(texts: DataFrame) -> DataFrame:
    """(file_name, content) -> one document per heading, in page order.

    Text in selected tags counts once: each piece runs from its start tag to the next selected start
    tag, cut after its last selected end tag. A heading without following text gives no document.
    """
    page = F.col("content")
    for tag in K.HTML_DROPPED_TAGS:
        page = F.regexp_replace(page, rf"(?is)<{tag}\b.*?</{tag}\s*>", "")
    title = F.regexp_extract("page", r"(?is)<title\b[^>]*>([^<]*)</title\s*>", 1)
    title = F.when(title == "", F.lit(K.FIRST_SECTION)).otherwise(strip(decode_entities(title)))
    body = F.regexp_replace("page", r"(?is)^.*?<body\b[^>]*>", "")
    no_empty_headings = F.regexp_replace(
        body, rf"(?is)<({_HEADING})\b[^>]*>(?:\s|&nbsp;|&#160;|{_OTHER_TAG})*+</\1\s*>", "")

    def section_of(part: Column) -> Column:
        """(heading or NULL, texts) of one stretch between headings."""
        pieces = F.filter(F.split(part, rf"(?i)(?=<(?:{_SELECTED})\b)"),
                          lambda p: p.rlike(rf"(?i)^<(?:{_SELECTED})\b"))
        shown = F.transform(pieces, lambda p: visible_text(
            F.regexp_replace(p, rf"(?is)^(.*</(?:{_SELECTED})\s*>).*$", "$1")))
        return F.struct(part.rlike(rf"(?i)^<(?:{_HEADING})\b").alias("headed"), shown.alias("texts"))

    def unit_of(section: Column) -> Column:
        title = F.when(section["headed"], F.get(section["texts"], F.lit(0))).otherwise(F.col("title"))
        rest = F.slice(section["texts"], F.when(section["headed"], 2).otherwise(1), F.size(section["texts"]) + 1)
        return F.struct(title.alias("section"),
                        clean(F.array_join(F.filter(rest, lambda t: t != ""), " ")).alias("body"))

    parts = F.split("body", rf"(?i)(?=<(?:{_HEADING})\b)")
    units = F.filter(F.transform(F.transform(parts, section_of), unit_of), lambda u: u["body"] != "")
    rows = (texts.select("file_name", page.alias("page"))
            .select("file_name", title.alias("title"), no_empty_headings.alias("body"))
            .select("file_name", F.posexplode_outer(units).alias("doc_seq", "unit"))
            .where("unit IS NOT NULL"))
    return as_documents(rows.select("file_name", "doc_seq", "unit.section",
                                    F.concat_ws("\n", "unit.section", "unit.body").alias("text")), "html")


def html_documents(spark: SparkSession, paths, glob: str | None = None) -> DataFrame:
    return html_sections(whole_texts(spark, paths, glob))

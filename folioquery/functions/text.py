"""Text columns: cleaning, folding, sentences, names."""

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column, functions as F

from folioquery import constants as K

_BLANKS = r"\s\x0B\x1C-\x1F\x85\p{Z}"


def strip(text: Column) -> Column:
    """Drop every kind of white space at both ends (Spark's trim only drops spaces)."""
    return F.regexp_replace(text, f"^[{_BLANKS}]+|[{_BLANKS}]+$", "")


def has_text(text: Column) -> Column:
    """True when something is left after cleaning. Filtering on this avoids cleaning twice, since Spark
    moves a filter on a computed column below the projection and repeats the expression there."""
    return text.rlike(f"[^{_BLANKS}]")


def clean(text: Column) -> Column:
    """Collapse blanks and runs of empty lines, then strip."""
    text = F.regexp_replace(text, r"[ \t]+", " ")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


@cache
def _accent_table() -> tuple[str, str]:
    accented, plain = [], []
    for code in range(0x80, sys.maxunicode + 1):
        char = chr(code)
        folded = "".join(c for c in unicodedata.normalize("NFD", char) if unicodedata.category(c) != "Mn")
        if folded != char and len(folded) == 1:
            accented.append(char)
            plain.append(folded)
    return "".join(accented), "".join(plain)


@cache
def _long_decompositions() -> dict[str, str]:
    """Characters other than Hangul syllables that come apart into several that stay."""
    found = {}
    for code in range(0x80, sys.maxunicode + 1):
        folded = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if unicodedata.category(c) != "Mn")
        if len(folded) > 1 and not _HANGUL[0] <= code <= _HANGUL[1]:
            found[chr(code)] = folded
    return found


_HANGUL = (0xAC00, 0xD7A3)


def _decomposed(text: Column) -> Column:
    """Hangul syllables as their letters, by the arithmetic of their block, and other characters that come apart."""
    def letters(char: Column) -> Column:
        place = F.ascii(char) - _HANGUL[0]
        parts = [(0x1100, 19, F.floor(place / 588)), (0x1161, 21, F.floor(place % 588 / 28)), (0x11A7, 28, place % 28)]
        said = [F.substring(F.lit("".join(map(chr, range(first, first + n)))), at.cast("int") + 1, F.lit(1)) for first, n, at in parts]
        return F.when((place >= 0) & (place <= _HANGUL[1] - _HANGUL[0]),
                      F.concat(said[0], said[1], F.when(place % 28 == 0, "").otherwise(said[2]))).otherwise(char)

    others = _long_decompositions()

    def apart(char: Column) -> Column:
        kinds = F.lit("".join(others))
        return F.coalesce(F.get(F.array(*map(F.lit, others.values())), F.instr(kinds, char) - 1), char)

    rare = "[" + "".join(others) + "]"
    text = F.when(text.rlike(rare), F.array_join(F.transform(F.split(text, ""), apart), "")).otherwise(text)
    return F.when(text.rlike("[가-힣]"), F.array_join(F.transform(F.split(text, ""), letters), "")).otherwise(text)


def fold_accents(text: Column) -> Column:
    """Lower case without accents, for name matching."""
    accented, plain = _accent_table()
    return F.regexp_replace(F.translate(_decomposed(F.lower(text)), accented, plain), r"\p{Mn}", "")


def labelled(label: str | Column, value: Column) -> Column:
    """``label: value``, NULL when the value is NULL."""
    label = F.lit(label) if isinstance(label, str) else label
    return F.concat(label, F.lit(": "), value.cast("string"))


def row_sentence(columns: list[str]) -> Column:
    """One sentence per record from named columns; NULL cells are skipped."""
    return F.concat_ws(". ", *[labelled(name, F.col(f"`{name}`")) for name in columns])


def cells_sentence(headers: Column, cells: Column) -> Column:
    """One sentence from a header array and a cell array, up to the shorter of the two."""
    width = F.least(F.size(headers), F.size(cells))
    pairs = F.arrays_zip(F.slice(headers, 1, width).alias("h"), F.slice(cells, 1, width).alias("v"))
    filled = F.filter(pairs, lambda p: p["v"].isNotNull() & (p["v"] != ""))
    return F.array_join(F.transform(filled, lambda p: labelled(p["h"], p["v"])), ". ")


def section_title(text: Column) -> Column:
    """First line without leading ``#`` and spaces."""
    return strip(F.regexp_extract(text, r"^[# ]*([^\n]*)", 1))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """Lower-cased last suffix with its dot, '' when there is none."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1))


def as_passage(text: Column) -> Column:
    return F.concat(F.lit(K.PASSAGE_PREFIX), text)


def as_query(text: Column) -> Column:
    return F.concat(F.lit(K.QUERY_PREFIX), text)


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def chosen_category(choice: Column) -> Column:
    """Category filter from a selection: the entry for all categories means no filter."""
    return F.nullif(choice, F.lit(K.ALL_CATEGORIES))


def has_word(text: Column) -> Column:
    return text.rlike(r"[\p{L}\p{N}]")


def reply_text(blocks: Column) -> Column:
    """Join the text of a reply that came as a list of blocks."""
    return F.array_join(F.transform(blocks, lambda b: F.coalesce(b["text"], F.lit(""))), " ")


def utc_stamp(moment: Column) -> Column:
    """ISO-8601 with offset; the session time zone is expected to be UTC."""
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")

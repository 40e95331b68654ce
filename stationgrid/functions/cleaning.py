"""Native column expressions that normalise raw feed values."""

from __future__ import annotations

import unicodedata
from html.entities import name2codepoint

from pyspark.sql import Column, functions as F

# --- fixed values -----------------------------------------------------------
NAME_KEYWORDS = ("min", "max", "średnia", "avg", "average", "z pomiarów")
NUMERIC_PATTERN = r"^-?\d+(?:[.,]\d+)?$"
ARROWS_AND_SPACE = r"[↓↑\s]"
RASTER_VALUE_FLOOR = -9000.0
RASTER_VALUE_CEILING = 1e6
# Latin letters that do not decompose into a base letter and marks.
WHOLE_LETTERS = {"ł": "l", "Ł": "L", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "ħ": "h", "Ħ": "H", "ı": "i"}
LIGATURES = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "Th"}
# ----------------------------------------------------------------------------


def clean_temperature(value: Column, comma: str = "dot") -> Column:
    """Text or number to DOUBLE; unparsable text becomes NULL.

    ``comma="dot"`` reads a comma as the decimal sign, ``comma="strip"`` drops it.
    """
    text = F.regexp_replace(value.cast("string"), ARROWS_AND_SPACE, "")
    text = F.regexp_replace(text, ",", "." if comma == "dot" else "")
    return null_if_nan(text.try_cast("double"))


def clean_station_name(name: Column) -> Column:
    """Remove the measurement keywords wherever they occur and trim white space."""
    keywords = "(?iu)" + "|".join(NAME_KEYWORDS)
    return F.regexp_replace(F.regexp_replace(name, keywords, ""), r"^\s+|\s+$", "")


def _marked_letters() -> dict[str, str]:
    """Latin letters with marks, by their decomposition, and those that have none."""
    letters = dict(WHOLE_LETTERS)
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base != chr(code) and base.isascii():
            letters[chr(code)] = base
    return letters


def ascii_fold(name: Column) -> Column:
    """Latin letters with marks, and ligatures, in plain letters; single combining marks go."""
    letters = _marked_letters()
    folded = F.translate(name, "".join(letters), "".join(letters.values()))
    for letter, plain in LIGATURES.items():
        folded = F.replace(folded, F.lit(letter), F.lit(plain))
    return F.regexp_replace(folded, r"\p{Mn}", "")


def decode_entities(text: Column) -> Column:
    """HTML character references, decimal, hexadecimal and by name, as their characters; unknown ones stay."""
    named = F.create_map(*(F.lit(x) for pair in name2codepoint.items() for x in (pair[0], chr(pair[1]))))
    part = F.regexp_extract_all(text, F.lit(r"(?s)&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);|[^&]+|&"), 0)

    def decode(p: Column) -> Column:
        inner = F.substring(p, F.lit(2), F.length(p) - 2)
        digits = F.when(F.lower(F.substring(inner, 2, 1)) == "x", F.conv(F.substring(inner, F.lit(3), F.length(inner)), 16, 16)).otherwise(
            F.conv(F.substring(inner, F.lit(2), F.length(inner)), 10, 16)
        )
        char = F.decode(F.unhex(F.lpad(digits, 8, "0")), "UTF-32")
        reference = (F.length(p) > 2) & p.startswith("&")
        return F.when(~reference, p).when(inner.startswith("#"), char).otherwise(F.coalesce(F.try_element_at(named, inner), p))

    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(part, decode), "")).otherwise(text)


def is_numeric_text(value: Column) -> Column:
    """True for an optional minus sign, digits and at most one decimal part."""
    return value.rlike(NUMERIC_PATTERN)


def null_if_nan(value: Column) -> Column:
    """NaN sorts above every number in Spark, so it must not reach an aggregate."""
    return F.when(~F.isnan(value), value)


def mask_nodata(value: Column, nodata: Column | float | None) -> Column:
    """NULL for the band's nodata value, NaN and physically impossible magnitudes."""
    bad = F.isnan(value) | (value < RASTER_VALUE_FLOOR) | (value > RASTER_VALUE_CEILING)
    if nodata is not None:
        nodata = nodata if isinstance(nodata, Column) else F.lit(float(nodata))
        bad = bad | F.coalesce(value == nodata, F.lit(False))
    return F.when(~bad, value)

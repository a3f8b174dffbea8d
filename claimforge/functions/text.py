"""Text and number expressions that keep the library's rules in one place."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a CSV field may hold in place of a null.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
#: A character reference: by number (decimal, hexadecimal) or by name.
REFERENCE = r"&(#[0-9]{1,7};?|#[xX][0-9a-fA-F]{1,6};?|[A-Za-z][A-Za-z0-9]{1,31};?)"
MISSING, UNKNOWN = "MISSING", "Unknown"


def na_to_null(c: Column) -> Column:
    return F.when(~c.isin(*NA_TOKENS), c)


def title(c: Column) -> Column:
    """Every letter after a non-letter upper-cased, all others lower-cased."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 1_000_000))), "")


def code(c: Column) -> Column:
    return F.upper(F.trim(c))


def safe_number(c: Column) -> Column:
    return c.try_cast("double")


def ratio(a: Column, b: Column, digits: int, scale: float = 1.0) -> Column:
    """scale * a / b, half-even, null where b is 0 or either is null."""
    return F.bround(F.try_divide(a.cast("double") * scale, b.cast("double")), digits)


def clip(c: Column, low: float, high: float) -> Column:
    """Null stays null (least and greatest alone would skip it)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def ellipsis(c: Column, most: int = 420) -> Column:
    """White space collapsed; longer texts cut to most - 1 characters and an ellipsis."""
    flat = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.rtrim(F.substring(flat, 1, most - 1)), F.lit("…"))).otherwise(flat)


def references_decoded(c: Column) -> Column:
    """Character references as characters, each once; unknown names stay as they are, numbers of no character become U+FFFD."""
    names = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")

    def char(r: Column) -> Column:
        digits = F.rtrim(F.substring(r, 2, 9), F.lit(";"))
        n = F.when(F.substring(digits, 1, 1).isin("x", "X"), F.conv(F.substring(digits, 2, 8), 16, 10)).otherwise(digits).try_cast("int")
        real = n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF)
        by_number = F.when(real, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise("\ufffd")
        return F.when(F.startswith(r, F.lit("#")), by_number).otherwise(F.coalesce(F.try_element_at(names, r), F.concat(F.lit("&"), r)))

    parts = F.arrays_zip(F.split(c, REFERENCE, -1).alias("t"), F.regexp_extract_all(c, F.lit(REFERENCE), F.lit(1)).alias("r"))
    return F.array_join(F.transform(parts, lambda x: F.concat(x["t"], F.when(x["r"].isNotNull(), char(x["r"])).otherwise(""))), "")


def html_to_text(c: Column) -> Column:
    """Visible text of a page: unseen elements dropped, block tags as line ends, at most one empty line in a row."""
    out = F.regexp_replace(c, r"(?is)<(script|style|noscript|svg)\b.*?</\1\s*>", "")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", "")
    out = F.regexp_replace(out, r"(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|header|footer|nav)\b[^>]*>", "\n")
    out = F.regexp_replace(out, r"<[^>]*>", "")
    out = F.regexp_replace(F.regexp_replace(references_decoded(out), r"[ \t\r\u00a0]+", " "), r" ?\n ?", "\n")
    return F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def tag_list(c: Column) -> Column:
    """A JSON array of strings, or else comma-separated words."""
    return F.coalesce(F.when(F.trim(c).startswith("["), F.from_json(c, "array<string>")), F.filter(F.transform(F.split(c, ","), lambda t: F.trim(t)), lambda t: t != ""))

"""Small text and time columns used by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_text(ts: Column) -> Column:
    """Timestamp to ISO-8601 text in UTC; the fraction appears only when it is not zero."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.when(micros == "000000", F.concat(whole, F.lit("Z"))).otherwise(
        F.concat(whole, F.lit("."), micros, F.lit("Z"))
    )


def json_text(value: Column) -> Column:
    """A string column as a quoted JSON string, null as ``null``."""
    # to_json needs a container; one-element arrays are the cheapest to unwrap.
    wrapped = F.to_json(F.array(value))
    return F.when(value.isNull(), F.lit("null")).otherwise(
        wrapped.substr(F.lit(2), F.length(wrapped) - 2)
    )


def localized(entries: Column, plain: Column, language: str) -> Column:
    """Text in a language, else the first entry, else the plain text.

    ``entries`` is an array of (lang, text): a map would not keep the order of its entries.
    """
    match = F.get(F.filter(entries, lambda e: e["lang"] == language), F.lit(0))["text"]
    first = F.get(entries, F.lit(0))["text"]
    has_language = F.exists(entries, lambda e: e["lang"] == language)
    return F.when(entries.isNull(), plain).when(has_language, match).otherwise(first)


def link_header(href: Column, rel: Column, media_type: Column, **extra: Column) -> Column:
    """A link as HTTP header text; null, empty and zero attributes are left out."""
    quoted = []
    for name, value in extra.items():
        text = value.cast("string")
        quoted.append(F.when(~text.isin("", "0"), F.concat(F.lit(f'{name}="'), text, F.lit('"'))))
    return F.concat_ws(
        "; ",
        F.concat(F.lit("<"), href, F.lit(">")),
        F.concat(F.lit('rel="'), rel, F.lit('"')),
        F.concat(F.lit('type="'), media_type, F.lit('"')),
        *quoted,
    )


def pattern_safe(text: str) -> str:
    """Escape LIKE wildcards so that user text matches itself only."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def contains_ci(column: Column, text: str) -> Column:
    """Case-insensitive substring test."""
    return column.ilike(f"%{pattern_safe(text)}%")

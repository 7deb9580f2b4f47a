"""Predicates and formats of the text types of the documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of the document contracts, whole-string.
IDENTIFIER = r"[A-Za-z0-9][A-Za-z0-9._-]{0,127}"
TENSOR_NAME = r"[A-Za-z0-9][A-Za-z0-9._-]{0,511}"
SHA256 = r"[0-9a-f]{64}"
COMMIT = r"(?:[0-9a-f]{40}|[0-9a-f]{64})"
UTC_TIMESTAMP = r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]{1,6})?Z"
#: White space that counts as blank, beyond what the regular expression class holds.
_BLANK = r"(?U)\A[\s\x1c-\x1f\x85]*\z"


def matches(text: Column, pattern: str) -> Column:
    """Whether the whole string matches; false for null. No trailing line end is let through."""
    return F.coalesce(text.rlike(rf"\A(?:{pattern})\z"), F.lit(False))


def is_identifier(text: Column) -> Column:
    return matches(text, IDENTIFIER)


def is_blank(text: Column) -> Column:
    """Empty or white space only, Unicode white space included; false for null."""
    return F.coalesce(text.rlike(_BLANK), F.lit(False))


def has_length(text: Column, least: int, most: int) -> Column:
    """Whether a text is there and has so many code points."""
    return F.coalesce(F.length(text).between(least, most), F.lit(False))


def valid_missing_reason(reason: Column, complete: Column) -> Column:
    """A reason is required exactly when evidence is missing, not blank and at most 4096 code points."""
    return F.when(complete, reason.isNull()).otherwise(reason.isNotNull() & ~is_blank(reason) & has_length(reason, 1, 4096))


def utc_text(ts: Column) -> Column:
    """UTC time with microseconds and ``Z``."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def utc_time(text: Column) -> Column:
    """The time of a well-formed UTC text, null when it is no real date or time."""
    good = F.when(matches(text, UTC_TIMESTAMP), text)
    return F.try_to_timestamp(F.regexp_replace(good, "Z$", ""))


#: Characters that would be read as markup and what stands for them, in this order.
_HTML = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))
_MARKDOWN = (("\\", "&#92;"), ("`", "&#96;"), ("*", "&#42;"), ("_", "&#95;"), ("[", "&#91;"), ("]", "&#93;"), ("|", "&#124;"), ("\r", "&#13;"), ("\n", "&#10;"))
ESCAPES = _HTML + _MARKDOWN


def escape_markdown(text: Column) -> Column:
    """Text that shows as itself in Markdown and in HTML."""
    for what, by in ESCAPES:
        text = F.replace(text, F.lit(what), F.lit(by))
    return text


def escape_markdown_text(text: str) -> str:
    for what, by in ESCAPES:
        text = text.replace(what, by)
    return text


def threshold_holds(operator: Column, aggregate: Column, value: Column) -> Column:
    """The declared comparison; null for an unknown operator or a number that is not finite."""
    from probeloom.functions.numeric import finite

    compared = (
        F.when(operator == "greater-than", aggregate > value)
        .when(operator == "greater-than-or-equal", aggregate >= value)
        .when(operator == "less-than", aggregate < value)
        .when(operator == "less-than-or-equal", aggregate <= value)
    )
    return F.when(finite(aggregate) & finite(value), compared)

"""Raw CSV text: first field, headings, safe names, row rendering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_CLOSED_FIELD = r'^"((?:[^"]++|"")*+)"'


# The characters that count as whitespace at the ends of a text.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    """Remove all leading and trailing whitespace (``trim`` removes spaces only)."""
    return F.btrim(c, F.lit(WHITESPACE))


def first_field(line: Column) -> Column:
    """First field of a raw CSV line, unquoted, with its own spacing kept.

    A quote that is never closed yields the rest of the line as it stands.
    """
    quoted = line.startswith('"')
    closed = F.regexp_replace(F.regexp_extract(line, _CLOSED_FIELD, 1), '""', '"')
    return (
        F.when(line.isNull(), "")
        .when(quoted & line.rlike(_CLOSED_FIELD), closed)
        .when(quoted, F.substring(line, 2, 2147483647))
        .otherwise(F.substring_index(line, ",", 1))
    )


def is_heading(value: Column, variant: str = "line") -> Column:
    """True for a value that opens a section.

    ``line``: starts with an uppercase letter, is not indented, is not ``Self time``.
    ``table``: the value is stripped first, so indentation never counts and
    ``Self time`` opens a section too.
    """
    if variant == "table":
        bare = F.regexp_replace(strip(value), r'(?s)^"(.*)"$', "$1")
        return F.coalesce(bare.rlike(r"^\p{IsUppercase}"), F.lit(False))
    if variant != "line":
        raise ValueError(f"unknown heading variant: {variant}")
    bare = F.btrim(F.btrim(value, F.lit('"')), F.lit("'"))
    return F.coalesce(bare.rlike(r"^\p{Lu}") & (strip(bare) != "Self time"), F.lit(False))


def safe_value_name(value: Column) -> Column:
    """Name of a value group, usable in a path and at most 50 characters long."""
    return F.substring(F.translate(value.cast("string"), "/\\:", "___"), 1, 50)


def safe_section_name(heading: Column) -> Column:
    """Name of a section, letters, digits and ``-_()[]`` only, at most 50 characters."""
    cleaned = F.regexp_replace(F.translate(heading, "/\\:", "___"), r"[^\p{L}\p{N}\-_()\[\]]", "")
    return F.substring(cleaned, 1, 50)


def render_row(row_idx: Column, columns: Sequence[str], side: str) -> Column:
    """``Row i: c=v, c=v`` with the columns of one side, in the given order."""
    pairs = [
        F.concat(F.lit(f"{c}="), F.coalesce(F.col(f"{side}.{c}").cast("string"), F.lit("nan"))) for c in columns
    ]
    return F.concat(F.lit("Row "), (row_idx + 1).cast("string"), F.lit(": "), F.concat_ws(", ", *pairs))


def blank_if_null(c: Column) -> Column:
    """Text of a value, with the empty string for a missing one."""
    return F.coalesce(c.cast("string"), F.lit(""))


def null_if_token(c: Column, tokens: Sequence[str]) -> Column:
    """NULL for text that stands for a missing value."""
    return F.when(~c.isin(*tokens), c)

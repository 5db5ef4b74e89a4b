"""Casts with explicit null rules.

Spark 4 runs with ANSI on, where a bad string raises. The reference ran with
ANSI off, where it gave null. The lenient forms here use ``try_cast`` (null);
``strict=True`` keeps the error.

A failed ``try_cast`` from text costs a Java exception per value, so a column
of words costs microseconds per row. For string inputs the lenient casts
first check that the text can be a number at all (it has a digit, or is one
of the special literals NaN / inf / infinity). That gives the same results
for about a tenth of the cost on such columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The digit-free spellings a string-to-float cast accepts
# (case-insensitive, optional sign, surrounded by control characters or spaces).
SPECIAL_FLOAT_TEXT = r"(?i)^[\x00-\x20]*[+-]?(nan|inf|infinity)[\x00-\x20]*$"


def could_be_number(c: Column) -> Column:
    """False only for text that no float cast can parse."""
    return c.rlike("[0-9]") | c.rlike(SPECIAL_FLOAT_TEXT)


def _lenient(c: Column, to: str, is_text: bool) -> Column:
    return F.when(could_be_number(c), c.try_cast(to)) if is_text else c.try_cast(to)


def to_float(c: Column, strict: bool = False, is_text: bool = False) -> Column:
    return c.cast("float") if strict else _lenient(c, "float", is_text)


def to_int(c: Column, strict: bool = False) -> Column:
    """Numbers are truncated toward zero (5.7 -> 5, -5.7 -> -5); NaN -> null."""
    return c.cast("int") if strict else c.try_cast("int")


def to_double(c: Column, strict: bool = False, is_text: bool = False) -> Column:
    return c.cast("double") if strict else _lenient(c, "double", is_text)

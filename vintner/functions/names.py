"""Identifier and column-name helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_name(name: str) -> str:
    """Column name as the cleaning step writes it: spaces become underscores."""
    return name.replace(" ", "_")


def sanitize_identifier(name: str) -> str:
    """Database / table name from user input: ``@`` and ``.`` become ``_``."""
    return name.replace("@", "_").replace(".", "_")


def strip_spaces(value: str) -> str:
    return value.replace(" ", "")


def quote(name: str) -> str:
    """Back-quote a column or table name so dots and spaces are taken literally."""
    return "`" + name.replace("`", "``") + "`"


def col_of(name: str) -> Column:
    return F.col(quote(name))


def sanitize_identifier_col(c: Column | str) -> Column:
    """Column form of :func:`sanitize_identifier`."""
    return F.translate(_as_col(c), "@.", "__")


def strip_spaces_col(c: Column | str) -> Column:
    """Column form of :func:`strip_spaces`."""
    return F.replace(_as_col(c), F.lit(" "), F.lit(""))


def _as_col(c: Column | str) -> Column:
    return col_of(c) if isinstance(c, str) else c

"""Cleaning of inventory and export text cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cell texts that mean "off".
OFF_WORDS = ("N", "NO", "FALSE", "0", "DISABLED")
# Cell texts that mean "no number".
NO_NUMBER_WORDS = ("", "NULL", "NONE")


def cell(c: Column) -> Column:
    """Trimmed text, null when nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def identifier(c: Column) -> Column:
    """Schema, table and column names compare trimmed and upper-cased."""
    return F.upper(F.trim(c))


def qualified(schema: Column, table: Column) -> Column:
    return F.concat_ws(".", schema, table)


def is_on(c: Column) -> Column:
    """Only the listed words switch a row off; blank and missing mean on."""
    return ~F.upper(F.coalesce(cell(c), F.lit("Y"))).isin(*OFF_WORDS)


def choice(c: Column, allowed: tuple[str, ...], default: str) -> Column:
    lowered = F.lower(F.trim(c))
    return F.when(lowered.isin(*allowed), lowered).otherwise(F.lit(default))


def name_list(c: Column) -> Column:
    """``"ssn, tax_id"`` to ``["SSN", "TAX_ID"]``; empty parts vanish."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ","), identifier)
    return F.filter(parts, lambda p: p != "")


def to_int(c: Column) -> Column:
    """``"12"`` and ``"12.0"`` to 12; blanks, null words and other text to null."""
    trimmed = F.trim(c)
    usable = F.when(~F.upper(trimmed).isin(*NO_NUMBER_WORDS), trimmed)
    return usable.try_cast("double").try_cast("int")


def to_count(c: Column) -> Column:
    """A row count; unreadable text counts as 0."""
    return F.coalesce(F.trim(c).try_cast("bigint"), F.lit(0).cast("bigint"))


def to_number(c: Column, default: float) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(float(default)))

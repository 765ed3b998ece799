"""Cleaning of loosely formatted text cells (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .times import normalise_date

# Texts that stand for "no value" once trimmed.
NULL_TOKENS = ["", "--", "N/A"]

# Unicode white space plus the four ASCII separators.
_EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"

# Unsigned digits with at most one dot. The guard is needed: a bare cast also takes signs and exponents.
_INTEGER = r"^[0-9]+$"
_FLOAT = r"^([0-9]+\.[0-9]*|\.[0-9]+)$"


def trim_cell(cell: Column) -> Column:
    """Strip white space of every kind from both ends."""
    return F.regexp_replace(cell, _EDGE_SPACE, "")


def blank_to_null(cell: Column) -> Column:
    """Null tokens become NULL; anything else is kept."""
    return F.when(~cell.isin(NULL_TOKENS), cell)


def int_value(cell: Column) -> Column:
    """The cell as an integer of up to 38 digits, NULL when it is not one."""
    return F.when(cell.rlike(_INTEGER), cell.try_cast("decimal(38,0)"))


def float_value(cell: Column) -> Column:
    """The cell as a float when it is digits with one dot, else NULL."""
    return F.when(cell.rlike(_FLOAT), cell.try_cast("double"))


def clean_text(cell: Column) -> Column:
    return blank_to_null(trim_cell(cell))


def clean_cell(cell: Column, is_date: bool) -> Column:
    """The cleaned cell as a variant: null, integer, float or text, as the content says."""
    text = clean_text(cell)
    if is_date:
        return normalise_date(text).cast("variant")
    return F.coalesce(
        int_value(text).cast("variant"), float_value(text).cast("variant"), text.cast("variant")
    )


def is_date_name(logical_name: str) -> bool:
    return "date" in logical_name.lower()

"""Text rules of building attributes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that mark a lift, types that do, types that never are one, slab types that aren't floors.
LIFT_WORDS = ("ELEVATOR", "LIFT", "ELEVADOR", "ASCENSOR", "ASCENSORE", "FAHRSTUHL", "AUFZUG")
LIFT_TYPES = ("ELEVATOR", "LIFT", "USERDEFINED", "NOTDEFINED")
NOT_LIFT_TYPES = ("ESCALATOR", "MOVINGWALKWAY", "CRANEWAY")
NOT_FLOOR_TYPES = ("ROOF", "BASESLAB")


def stripped(c: Column) -> Column:
    """Without white space of any kind at both ends (trim() only takes blanks)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def or_default(c: Column, default: str) -> Column:
    """The default for null and empty text."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def type_name(c: Column, strip: bool = False) -> Column:
    out = F.upper(F.coalesce(c, F.lit("")))
    return stripped(out) if strip else out


def is_lift_by_text(predefined: Column, *texts: Column) -> Column:
    """By type, or by a keyword anywhere in one of the texts; missing text is empty."""
    found = type_name(predefined, strip=True).isin(*LIFT_TYPES)
    for t in texts:
        found |= type_name(t).rlike("|".join(LIFT_WORDS))
    return found


def joined_levels(a: Column, b: Column) -> Column:
    """Distinct level names of two endpoints, sorted, joined by a bar."""
    return F.array_join(F.array_sort(F.array_distinct(F.array(a, b))), "|")

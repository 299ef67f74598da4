"""CSS lengths and word-processor units as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Points per unit.
POINTS = {"pt": 1.0, "px": 0.75, "pc": 12.0, "in": 72.0, "cm": 72 / 2.54, "mm": 72 / 25.4, "q": 72 / 101.6}
EMU_PER_PIXEL = 9525

_NUMBER = r"\A\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?)([a-z%]*)\s*\z"


def to_points(value: Column, em: Column | float | None = None, rem: Column | float | None = None, percent_of: Column | float | None = None) -> Column:
    """Points of a CSS length; null where it is none, or its base is not given. Without a unit only 0 is one."""
    low = F.lower(value)
    number = F.regexp_extract(low, _NUMBER, 1).try_cast("double")
    unit = F.regexp_extract(low, _NUMBER, 2)
    base = lambda b, share: F.lit(None).cast("double") if b is None else (F.lit(b) if not isinstance(b, Column) else b) * share
    out = F.when(unit == "", F.when(number == 0, F.lit(0.0)))
    for name, points in POINTS.items():
        out = out.when(unit == name, number * F.lit(points))
    out = out.when(unit == "em", number * base(em, 1.0)).when(unit == "rem", number * base(rem, 1.0))
    out = out.when(unit.isin("ex", "ch"), number * base(em, 0.5)).when(unit == "%", number * base(percent_of, 0.01))
    return out


def half_away(value: Column) -> Column:
    """Rounded to a whole number, halves away from zero."""
    return (F.signum(value) * F.floor(F.abs(value) + 0.5)).cast("long")


def points_to_twips(points: Column) -> Column:
    return half_away(points * 20)


def millimetres_to_twips(mm: Column) -> Column:
    return half_away(mm * 1440 / 25.4)


def inches_to_twips(inches: Column) -> Column:
    return half_away(inches * 1440)


def pixels_to_emu(px: Column) -> Column:
    return half_away(px * EMU_PER_PIXEL)


def twips_to_pixels(twips: Column) -> Column:
    return half_away(twips / 15)


def measure_to_twips(value: Column) -> Column:
    """OOXML measure: plain twips, or a number with mm, cm, in, pt, pc or pi."""
    number = F.regexp_extract(value, r"\A\s*(-?[0-9]+(?:\.[0-9]+)?)(mm|cm|in|pt|pc|pi)?\s*\z", 1).try_cast("double")
    unit = F.regexp_extract(value, r"\A\s*(-?[0-9]+(?:\.[0-9]+)?)(mm|cm|in|pt|pc|pi)?\s*\z", 2)
    scale = F.when(unit == "", 1.0).when(unit == "mm", 1440 / 25.4).when(unit == "cm", 1440 / 2.54).when(unit == "in", 1440.0).when(unit == "pt", 20.0).otherwise(240.0)
    return half_away(number * scale)

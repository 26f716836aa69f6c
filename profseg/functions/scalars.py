"""Scalar expressions on columns. Missing is NULL; NaN and infinities are turned into NULL where they enter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Floors of logarithms, class bounds of the soil behaviour index, the stress ratio of the upper zones.
LOG_FLOOR, INDEX_FLOOR = 1e-3, 1e-6
INDEX_BOUNDS = (1.31, 2.05, 2.60, 2.95, 3.60)
UPPER_RATIO = 160.0


def finite(x: Column) -> Column:
    """x, or NULL if it isn't finite."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def as_number(x: Column) -> Column:
    """Text to a finite double; anything else is NULL."""
    return finite(x.try_cast("double"))


def safe_log10(x: Column) -> Column:
    return F.log10(F.greatest(finite(x), F.lit(LOG_FLOOR)))


def log1p_positive(x: Column) -> Column:
    """log1p of positive values, NULL for others."""
    return F.when(x > 0, F.log1p(x))


def log1p_from_zero(x: Column) -> Column:
    """log1p of values from 0 on, NULL for others."""
    return F.when(x >= 0, F.log1p(x))


def log1p_clipped(x: Column) -> Column:
    """log1p with negatives counted as 0."""
    return F.when(x.isNotNull(), F.log1p(F.greatest(x, F.lit(0.0))))


def friction_ratio(sleeve: Column, cone: Column, positive: bool = True) -> Column:
    """sleeve / cone where cone is positive (or, else, not zero)."""
    return F.when((cone > 0) if positive else (cone != 0), F.try_divide(sleeve, cone))


def relative_depth(depth: Column, top: Column, bottom: Column) -> Column:
    """Place of a depth in its segment, within 0 and 1; 0 in a segment without thickness."""
    place = F.try_divide(depth - top, bottom - top)
    return F.when(bottom > top, F.least(F.greatest(place, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)


def soil_index(ratio: Column, friction: Column) -> Column:
    a = F.lit(3.47) - F.log10(F.greatest(ratio, F.lit(INDEX_FLOOR)))
    b = F.log10(F.greatest(friction, F.lit(INDEX_FLOOR))) + 1.22
    return F.sqrt(a * a + b * b)


def soil_zone(index: Column, ratio: Column) -> Column:
    """Zones 6 down to 1 by growing index; 7 to 9 where the ratio reaches UPPER_RATIO."""
    b = INDEX_BOUNDS
    upper = F.when(index < b[0], 7).when(index < b[1], 8).otherwise(9)
    lower = F.when(index < b[0], 6).when(index < b[1], 5).when(index < b[2], 4).when(index < b[3], 3).when(index < b[4], 2).otherwise(1)
    return F.when(index.isNotNull() & ratio.isNotNull(), F.when(ratio >= UPPER_RATIO, upper).otherwise(lower))


def valid_pair(ratio: Column, friction: Column) -> Column:
    return ratio.isNotNull() & friction.isNotNull() & (ratio > 0) & (friction > 0)


def slug(text: Column) -> Column:
    """Lower-case letters, digits and single dashes."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "-"), "^-|-$", "")


def safe_name(text: Column) -> Column:
    """Usable as a file name."""
    return F.regexp_replace(text, "[^A-Za-z0-9._-]+", "_")

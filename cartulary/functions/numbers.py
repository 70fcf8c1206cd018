"""Numeric functions with the rounding and median rules that results depend on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounding with halves towards plus infinity."""
    scale = F.lit(float(10**digits))
    return F.floor(x * scale + 0.5) / scale


def upper_median(x: Column) -> Column:
    """As an aggregate: the value at position floor(n / 2) of the sorted values."""
    ordered = F.sort_array(F.collect_list(x))
    return F.element_at(ordered, (F.floor(F.size(ordered) / 2) + 1).cast("int"))


def luminance(hex_colour: Column) -> Column:
    """Relative luminance of ``rrggbb``."""

    def channel(at: int) -> Column:
        c = F.conv(F.substring(hex_colour, at, 2), 16, 10).cast("double") / 255
        return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))

    return 0.2126 * channel(1) + 0.7152 * channel(3) + 0.0722 * channel(5)


def contrast(a: Column, b: Column) -> Column:
    la, lb = luminance(a), luminance(b)
    return (F.greatest(la, lb) + 0.05) / (F.least(la, lb) + 0.05)


def syllables(word: Column) -> Column:
    """Vowel groups without one trailing e, one at least (ASCII vowels)."""
    stem = F.regexp_replace(F.lower(word), "e$", "")
    return F.greatest(F.lit(1), F.regexp_count(stem, F.lit("[aeiouy]+")))

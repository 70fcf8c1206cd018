"""Dates told from another date."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units from the largest, with their seconds. Fixed values.
UNITS = (("year", 31536000), ("month", 2592000), ("week", 604800), ("day", 86400), ("hour", 3600), ("minute", 60))


def relative(then: Column, now: Column) -> Column:
    """``3 days ago``, ``in 1 hour``, ``just now``: the largest unit of which one at least has passed, cut to a whole number."""
    gap = F.unix_seconds(now) - F.unix_seconds(then)
    told = F.lit("just now")
    for unit, seconds in reversed(UNITS):
        n = F.floor(F.abs(gap) / seconds)
        phrase = F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"))
        told = F.when(n >= 1, F.when(gap > 0, F.concat(phrase, F.lit(" ago"))).otherwise(F.concat(F.lit("in "), phrase))).otherwise(told)
    return F.when(gap.isNotNull(), told)

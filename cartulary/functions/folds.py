"""Running folds over arrays, whose time is near linear in their length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numbers that are folded together.
FOLD_BLOCK = 128


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often and inside whatever lambda it is used."""
    return F.transform(F.array(value), use)[0]


def running(numbers: Column, join: Callable[[Column, Column], Column]) -> Column:
    """What ``join``, which must be associative, makes of each number of an array of longs and all before it.

    An array grows by copying, so numbers are folded within blocks, and the
    folded blocks among themselves.
    """

    def fold(xs: Column) -> Column:
        start = F.struct(F.lit(None).cast("long").alias("at"), F.array().cast("array<bigint>").alias("upto"))

        def step(acc: Column, x: Column) -> Column:
            at = F.coalesce(join(acc["at"], x), x)
            return F.struct(at.alias("at"), F.concat(acc["upto"], F.array(at)).alias("upto"))

        return F.aggregate(xs, start, step)

    def of_blocks(blocks: Column) -> Column:
        within = lambda before: F.flatten(F.transform(blocks, lambda b, i: F.when(i == 0, b["upto"]).otherwise(F.transform(b["upto"], lambda x: join(before[i - 1], x)))))
        return bound(fold(F.transform(blocks, lambda b: b["at"]))["upto"], within)

    def of_array(xs: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(xs), F.lit(FOLD_BLOCK))
        return bound(F.transform(starts, lambda i: fold(F.slice(xs, i, F.lit(FOLD_BLOCK)))), of_blocks)

    return F.when(F.size(numbers) > 0, bound(numbers, of_array)).otherwise(F.array().cast("array<bigint>"))


def running_sums(numbers: Column) -> Column:
    """Running sums of an array of longs, itself included."""
    return running(numbers, lambda a, b: a + b)


def running_maxima(numbers: Column) -> Column:
    """The greatest of each number of an array of longs and all before it."""
    return running(numbers, lambda a, b: F.when(a.isNotNull(), F.greatest(a, b)))

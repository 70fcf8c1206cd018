"""Helpers that several training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.folds import bound, running_maxima, running_sums
from ..operators.graph import connected_components
from ..plans.scratch import materialize, scratch_dir
from ..session import ARROW_BATCH_BYTES, small_batches

__all__ = ["ARROW_BATCH_BYTES", "bound", "connected_components", "cut", "materialize", "running_maxima", "running_sums", "scratch_dir", "small_batches", "text_blocks"]

#: Code points of a block of text.
TEXT_BLOCK = 1024


def text_blocks(text: Column) -> Column:
    """A text as blocks of ``TEXT_BLOCK`` code points, for ``cut``."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{TEXT_BLOCK}}}"), F.lit(0))


def cut(blocks: Column, begin: Column, end: Column) -> Column:
    """Code points ``begin`` to ``end`` (exclusive) of a text in blocks; unlike a substring of the whole text it does not walk from the start."""
    first, last = F.floor(begin / TEXT_BLOCK).cast("int"), F.floor((end - 1) / TEXT_BLOCK).cast("int")
    head = F.substring(F.get(blocks, first), (begin - first * TEXT_BLOCK + 1).cast("int"), F.least(end - begin, F.lit(TEXT_BLOCK)).cast("int"))
    inner = F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    tail = F.substring(F.get(blocks, last), F.lit(1), (end - last * TEXT_BLOCK).cast("int"))
    return F.when(end <= begin, "").when(first == last, head).otherwise(F.concat(head, inner, tail))

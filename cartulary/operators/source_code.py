"""Measures of script source: functions by length, nesting and branches.

A text is read once. Strings, templates and comments are blanked first, so that
braces in them do not count; then one pass with a stack pairs the braces, and a
function's lines and branches are differences of sorted positions. Time is near
linear in the text, however many functions lie in each other.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import small_batches

FUNCTIONS = "page_id long, name string, line int, lines int, depth int, branches int"
#: Bounds from which a function is told, and what a level weighs: fixed values.
LONG, DEEP, BRANCHED, LEVEL = 40, 4, 10, 10

_SILENT = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`""", re.S)
_ARGS = r"\((?:[^()]|\([^()]*\))*\)"
_WORD = r"[A-Za-z_$][\w$]*"
_HEADER = re.compile(rf"\bfunction\b\s*\*?\s*({_WORD})?\s*{_ARGS}\s*\{{|(?:({_WORD})\s*[:=]\s*)?(?:async\s+)?(?:{_ARGS}|{_WORD})\s*=>\s*\{{|(?<![\w$.])({_WORD})\s*{_ARGS}\s*\{{")
_NO_METHOD = {"if", "for", "while", "switch", "catch", "with", "function", "return"}
_BRANCH = re.compile(r"\b(?:if|for|while|case)\b|&&|\|\||\?")


def silenced(source: str) -> str:
    """The source with what stands in strings and comments blanked, line ends kept."""
    return _SILENT.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)


def functions_of(source: str | None) -> list[tuple[str, int, int, int, int]]:
    """``(name, line, lines, depth, branches)`` of each function and method, inner ones too, in order."""
    text = silenced(source or "")
    heads = {m.end() - 1: m for m in _HEADER.finditer(text) if m[3] not in _NO_METHOD}
    newlines = [m.start() for m in re.finditer("\n", text)]
    branches = [m.start() for m in _BRANCH.finditer(text)]
    found: dict[int, tuple[str, int, int, int, int]] = {}
    stack: list[list[int]] = []

    def close(end: int) -> None:
        at, deepest = stack.pop()
        if stack:
            stack[-1][1] = max(stack[-1][1], deepest + 1)
        if head := heads.get(at):
            within = lambda places: bisect_left(places, end) - bisect_left(places, at)
            found[at] = (head[1] or head[2] or head[3] or "", bisect_left(newlines, head.start()) + 1, within(newlines) + 1, deepest, within(branches))

    for m in re.finditer("[{}]", text):
        if m[0] == "{":
            stack.append([m.start(), 1])
        elif stack:
            close(m.start())
    while stack:
        close(len(text))
    return [found[at] for at in sorted(found)]


def complexity(pages: DataFrame, id_col: str = "page_id", source_col: str = "html") -> DataFrame:
    """Functions of each source; null and empty sources have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, *f) for i, s in zip(batch["page_id"], batch["source"]) for f in functions_of(s)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FUNCTIONS.split(", ")])

    small_batches(pages.sparkSession)
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(source_col).alias("source")).mapInPandas(run, FUNCTIONS)


def over_bounds(lines: int = LONG, depth: int = DEEP, branches: int = BRANCHED) -> Column:
    return (F.col("lines") > lines) | (F.col("depth") >= depth) | (F.col("branches") >= branches)


def complex_functions(found: DataFrame) -> DataFrame:
    """Functions over one of the bounds, with their weight (lines, ten a level, branches)."""
    return found.where(over_bounds()).withColumn("weight", F.col("lines") + LEVEL * F.col("depth") + F.col("branches"))

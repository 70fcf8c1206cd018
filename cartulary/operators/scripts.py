"""Scripts read by position: matches with their place and line, chains of promises, pyramids of callbacks.

A text is read once, in the task that holds it, into a table of positions. What
belongs together is found by Spark: counterparts by an anti join, chains as
islands of matches with no wide gap between them. Nesting needs an automaton: it
reads braces in one pass and knows strings, templates and comments.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import small_batches

MATCHES = "id long, rule string, place long, line int, name string"
#: Characters between two links of one chain at most, and links and open callbacks from which they are told: fixed values.
CHAIN_GAP, LONG, DEEP = 400, 3, 3
LINK = r"\.\s*(?:then|catch|finally)\s*\("

_CALLBACK = re.compile(r"(?:async\s+)?(?:function\b\s*\*?\s*[\w$]*\s*\([^)]*\)|\([^)]*\)\s*=>|[A-Za-z_$][\w$]*\s*=>)\s*\{")
_SIGN = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|[(,{}]|\s+""", re.S)


def _rows(texts: DataFrame, schema: str, of_text: Callable[[str], list[tuple]], id_col: str, text_col: str) -> DataFrame:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    names, types = zip(*[(n, kinds[t]) for n, t in (c.split() for c in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *r) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if text for r in of_text(text)]
            columns = list(zip(*rows)) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], list(names))

    small_batches(texts.sparkSession)
    return texts.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def matches(texts: DataFrame, rules: dict[str, str], id_col: str, text_col: str) -> DataFrame:
    """``(id, rule, place, line, name)``: every match of every rule, the line it begins on and its first group, if it has one."""
    compiled = [(rule, re.compile(pattern)) for rule, pattern in rules.items()]

    def of_text(text: str) -> list[tuple]:
        ends = [m.start() for m in re.finditer("\n", text)]
        return [(rule, m.start(), bisect_left(ends, m.start()) + 1, (m[1] or "") if pattern.groups else "") for rule, pattern in compiled for m in pattern.finditer(text)]

    return _rows(texts, MATCHES, of_text, id_col, text_col)


def chains(texts: DataFrame, id_col: str, text_col: str, gap: int = CHAIN_GAP, least: int = LONG) -> DataFrame:
    """``(id, kind, line, depth)``: runs of ``least`` promise links or more with at most ``gap`` characters between their beginnings."""
    links = matches(texts, {"link": LINK}, id_col, text_col)
    order = Window.partitionBy("id").orderBy("place")
    new = F.coalesce(F.col("place") - F.lag("place").over(order) > gap, F.lit(True))
    islands = links.withColumn("new", new).withColumn("island", F.count_if("new").over(order))
    runs = islands.groupBy("id", "island").agg(F.min("line").alias("line"), F.count("*").cast("int").alias("depth"))
    return runs.where(F.col("depth") >= least).select("id", F.lit("promise-chain").alias("kind"), "line", "depth")


def callback_depths(text: str, least: int = DEEP) -> list[tuple[str, int, int]]:
    """``(kind, line, depth)`` of each brace at which ``least`` callbacks or more stand open in each other."""
    ends = [m.start() for m in re.finditer("\n", text)]
    opens, found = [], []
    depth, at, argument = 0, 0, False
    while at < len(text):
        sign = _SIGN.match(text, at)
        if argument and not (sign and (sign[0][0].isspace() or sign[0][:2] in ("//", "/*"))):
            argument = False
            if callback := _CALLBACK.match(text, at):
                depth += 1
                opens.append(depth)
                if len(opens) >= least:
                    found.append(("callback-pyramid", bisect_left(ends, callback.end() - 1) + 1, len(opens)))
                at = callback.end()
                continue
        if not sign:
            at += 1
            continue
        argument |= sign[0] in ("(", ",")
        if sign[0] == "{":
            depth += 1
        elif sign[0] == "}":
            if opens and opens[-1] == depth:
                opens.pop()
            depth = max(0, depth - 1)
        at = sign.end()
    return found


def pyramids(texts: DataFrame, id_col: str, text_col: str, least: int = DEEP) -> DataFrame:
    """``(id, kind, line, depth)``: callbacks, given as arguments, that open inside ``least - 1`` others or more."""
    return _rows(texts, "id long, kind string, line int, depth int", lambda text: callback_depths(text, least), id_col, text_col)


def async_findings(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, kind, line, depth)``: long chains and deep pyramids. Null and empty texts have none."""
    return chains(texts, id_col, text_col).unionByName(pyramids(texts, id_col, text_col))


def inline_scripts(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``(id, text)``: what stands in a page's script elements, all else blanked, so that lines stay those of the page."""
    element = r"(?is)<script[^>]*>(.*?)</script>"
    lines = lambda c: F.regexp_replace(c, "[^\n]", "")
    outside, inside = F.split(html_col, element, -1), F.regexp_extract_all(html_col, F.lit(element))
    opened = F.regexp_extract_all(html_col, F.lit(r"(?is)(<script[^>]*>).*?</script>"))
    whole = F.zip_with(F.slice(outside, F.lit(1), F.size(inside)), F.arrays_zip(opened.alias("o"), inside.alias("i")), lambda out, s: F.concat(lines(out), lines(s["o"]), s["i"]))
    return pages.select(F.col(id_col).alias("id"), F.array_join(whole, " ").alias("text")).where("text <> ''")


#: Calls that begin something, and what ends it; group 1 is the name they share, if any. The last field is the kind.
_NAME = r"\(\s*[\"'`]([^\"'`\n]+)[\"'`]"
PAIRED = (
    (rf"addEventListener{_NAME}", rf"removeEventListener{_NAME}", "listener-never-removed"),
    (r"setInterval\s*\(", r"clearInterval\s*\(", "interval-never-cleared"),
    (r"setTimeout\s*\(", r"clearTimeout\s*\(", "timeout-never-cleared"),
    (r"requestAnimationFrame\s*\(", r"cancelAnimationFrame\s*\(", "frame-never-cancelled"),
    (r"new\s+(?:Intersection|Mutation|Resize|Performance)Observer\s*\(", r"\.disconnect\s*\(", "observer-never-disconnected"),
    (rf"(?:local|session)Storage\s*\.\s*setItem{_NAME}", rf"(?:local|session)Storage\s*\.\s*getItem{_NAME}", "stored-never-read"),
)


def unpaired(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``(page_id, line, kind, detail)``: listeners, timers, observers and stored keys of a page that nothing in the
    same page ends or reads.

    Both sides of a pair are taken from the whole text, over line ends, in one
    scan; a row without its counterpart, by page, kind and name, is a finding.
    Pairs that share no name match by kind alone.
    """
    found = matches(pages, {f"{side}:{kind}": pattern for opened, closed, kind in PAIRED for side, pattern in (("open", opened), ("close", closed))}, id_col, html_col)
    part = found.select(F.col("id").alias("page_id"), "line", F.split_part("rule", F.lit(":"), F.lit(1)).alias("side"), F.split_part("rule", F.lit(":"), F.lit(2)).alias("kind"), F.col("name").alias("detail"))
    closed = part.where("side = 'close'").select("page_id", "kind", "detail").distinct()
    return part.where("side = 'open'").drop("side").join(closed, ["page_id", "kind", "detail"], "left_anti").select("page_id", "line", "kind", "detail")

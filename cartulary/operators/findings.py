"""One findings table for all pattern analyzers: a single pass over the pages.

A finding is a match of a rule, with the line it begins on and what it matched.
Rules are scanned only where a text that the rule cannot do without occurs, so
a page costs little for rules that it does not hit. Reports and scorecards are
aggregates of the table.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import small_batches
from .analyzers import ANALYZERS

FINDINGS = "page_id long, analyzer string, kind string, severity string, line int, evidence string"
#: Kinds that are more than a note.
HIGH = {("security", "eval"), ("security", "inner-html"), ("security", "script-scheme"), ("auth", "token-storage"), ("perf", "document-write"), ("perf", "sync-xhr"), ("platform", "flash"), ("platform", "activex"), ("platform", "applet")}
MEDIUM = {("security", "blank-target"), ("security", "http-link"), ("a11y", "no-lang"), ("a11y", "positive-tabindex"), ("console", "debugger"), ("console", "alert"), ("css", "important"), ("inline", "handler"), ("media", "autoplay"), ("env", "endpoint-literal"), ("dates", "parse"), ("cookies", "write"), ("render_blocking", "blocking-style"), ("render_blocking", "head-script")}


def severity(analyzer: str, kind: str) -> str:
    return "high" if (analyzer, kind) in HIGH else "medium" if (analyzer, kind) in MEDIUM else "note"


def mandatory(pattern: str) -> str:
    """The longest plain text that every match of ``pattern`` contains; empty if the pattern's top level shows none."""
    best = run = ""
    for op, value in re._parser.parse(pattern):
        run = run + chr(value) if op is re._constants.LITERAL else ""
        best = max(best, run, key=len)
    return best


def findings(pages: DataFrame, rules: dict[str, list[tuple[str, str]]] = ANALYZERS, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row for each match of each rule. Null and empty pages have none."""
    schema = pa.schema([("page_id", pa.int64()), ("analyzer", pa.string()), ("kind", pa.string()), ("severity", pa.string()), ("line", pa.int32()), ("evidence", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(mandatory(p), re.compile(p), a, k, severity(a, k)) for a, kinds in rules.items() for k, p in kinds]
        for batch in batches:
            rows = []
            for page_id, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not html:
                    continue
                ends = [m.start() for m in re.finditer("\n", html)]
                for needed, pattern, analyzer, kind, grade in compiled:
                    if needed in html:
                        rows += [(page_id, analyzer, kind, grade, bisect_left(ends, m.start()) + 1, m[0]) for m in pattern.finditer(html)]
            columns = list(zip(*rows)) or [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    small_batches(pages.sparkSession)
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("html")).mapInArrow(run, FINDINGS)


def rule_table(spark: SparkSession, rules: dict[str, list[tuple[str, str]]]) -> DataFrame:
    """``(analyzer, kind, severity)`` of each rule: as many rows as there are rules."""
    return spark.createDataFrame([(a, k, severity(a, k)) for a, kinds in rules.items() for k, _ in kinds], "analyzer string, kind string, severity string")


def report(found: DataFrame, rules: dict[str, list[tuple[str, str]]] = ANALYZERS) -> DataFrame:
    """``(analyzer, kind, severity, hits, pages)`` for each rule, with zeros where nothing was found."""
    per_page = found.groupBy("analyzer", "kind", "page_id").agg(F.count("*").alias("n"))
    counts = per_page.groupBy("analyzer", "kind").agg(F.sum("n").alias("hits"), F.count("*").alias("pages"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rule_table(found.sparkSession, rules).join(counts, ["analyzer", "kind"], "left").select("analyzer", "kind", "severity", zero("hits"), zero("pages"))


def scorecard(found: DataFrame, pages: DataFrame, id_col: str = "page_id", ceiling: float = 0.25, rules: dict[str, list[tuple[str, str]]] = ANALYZERS) -> DataFrame:
    """``(analyzer, findings, worst, pages, share, passes)``: the share of pages with a finding that is more than a note, against a
    ceiling; analyzers of ``rules`` that found nothing have zeros and ``none``."""
    total = pages.agg(F.count_distinct(id_col).alias("total"))
    rank = F.when(F.col("severity") == "high", 2).when(F.col("severity") == "medium", 1).otherwise(0)
    per_page = found.groupBy("analyzer", "page_id").agg(F.count("*").alias("n"), F.max(rank).alias("worst"))
    counts = per_page.groupBy("analyzer").agg(F.sum("n").alias("findings"), F.max("worst").alias("worst"), F.count_if(F.col("worst") > 0).alias("pages"))
    # every analyzer ran, so one without findings has zeros; those that did not run have no row
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    cards = rule_table(found.sparkSession, rules).select("analyzer").distinct().join(counts, "analyzer", "left").select("analyzer", zero("findings"), zero("pages"), "worst")
    share = F.round(F.coalesce(F.col("pages") / F.nullif("total", F.lit(0)), F.lit(0.0)), 4)
    worst = F.coalesce(F.try_element_at(F.array(F.lit("note"), F.lit("medium"), F.lit("high")), F.col("worst") + 1), F.lit("none"))
    return cards.crossJoin(F.broadcast(total)).select("analyzer", "findings", worst.alias("worst"), "pages", share.alias("share"), (share <= ceiling).alias("passes"))  # total is one row

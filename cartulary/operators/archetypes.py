"""What kind of application a page is part of: eleven shapes of four signals each.

A signal is a condition over a table of features, in SQL that Spark and others
read alike. Confidence is the share of a shape's signals that hold; two at least
make a verdict, and nothing is asserted from one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Features of a page or screen: counts, and texts' words and query names as flags.
FEATURES = (
    "tables", "loops", "nested_loops", "inputs", "submits", "buttons", "forms", "models", "search_fields", "destructive", "links", "headings", "charts", "editors", "step_markers",
    "reads", "writes", "by_id", "collections", "queries", "dated_queries", "moving_writes", "form_screens", "transitions", "widgets", "components",
    "board_words", "calendar_words", "chat_words", "draft_words",
)

#: Shapes and their signals.
ARCHETYPES = {
    "crud-table": ("tables > 0 OR loops > 0", "reads > 0", "writes > 0", "destructive > 0"),
    "master-detail": ("loops > 0", "by_id > 0", "collections > 0", "links > 1"),
    "search-and-filter": ("search_fields > 0", "loops > 0", "models > 0", "queries > 0"),
    "form-entry": ("inputs >= 2", "submits > 0", "writes > 0", "forms > 0"),
    "wizard": ("step_markers > 1", "inputs >= 2", "form_screens > 1", "transitions > 1"),
    "dashboard": ("charts > 0", "headings > 2", "reads > 2", "writes = 0"),
    "kanban": ("nested_loops > 0", "board_words > 0", "moving_writes > 0", "loops >= 2"),
    "calendar": ("calendar_words > 0", "tables > 0 OR nested_loops > 0", "dated_queries > 0", "buttons >= 2"),
    "chat": ("loops > 0", "(inputs > 0 OR models > 0) AND submits > 0", "chat_words > 0", "writes > 0"),
    "editor": ("editors > 0", "draft_words > 0", "writes > 0", "loops = 0"),
    "selector-soup": ("widgets > 0", "components = 0", "widgets > 4", "reads + writes > 0"),
}
#: Signals that make a verdict.
LEAST = 2


def classify(features: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, archetype, confidence, matched)``: every shape with enough signals; features that the table lacks count as zero, nulls too."""
    full = features.select(*keys, *[(F.coalesce(F.col(f), F.lit(0)) if f in features.columns else F.lit(0)).alias(f) for f in FEATURES])
    scores = F.array(*[F.struct(F.lit(name).alias("archetype"), sum((F.expr(f"CAST({s} AS INT)") for s in signals), F.lit(0)).alias("matched")) for name, signals in ARCHETYPES.items()])
    found = full.select(*keys, F.explode(F.filter(scores, lambda s: s["matched"] >= LEAST)).alias("s"))
    return found.select(*keys, "s.archetype", (F.col("s.matched") / 4).alias("confidence"), "s.matched")

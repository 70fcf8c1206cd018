"""What recorded screens get wrong: names, labels, sizes, contrast and the order of focus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import contrast

#: Contrast that normal and large text needs, pixels of a target, and pixels of a row of reading: fixed values.
NORMAL, LARGE, TARGET, ROW = 4.5, 3.0, 44, 16
COLUMNS = ("screen", "element", "kind", "severity")
#: Columns of a recorded element.
ELEMENT = "screen string, place long, selector string, tag string, name string, labelled boolean, disabled boolean, tabindex int, x double, y double, w double, h double"


def _findings(rows: DataFrame, element: str, kind: str, severity: Column | str) -> DataFrame:
    return rows.select("screen", F.col(element).alias("element"), F.lit(kind).alias("kind"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"))


def element_findings(elements: DataFrame) -> DataFrame:
    """Controls without a name, fields without a label, and targets that are too small."""
    named = F.coalesce(F.col("name").rlike(r"[\p{L}\p{N}]{2,}"), F.lit(False))
    nameless = elements.where(F.col("tag").isin("button", "a") & ~named)
    bare = elements.where(F.col("tag").isin("input", "select", "textarea") & ~F.coalesce("labelled", F.lit(False)))
    small = elements.where(F.col("tag").isin("button", "a", "input", "select") & (F.col("w") > 0) & (F.col("h") > 0) & (F.least("w", "h") < TARGET))
    return _findings(nameless, "selector", "accessible-name", "high").unionByName(_findings(bare, "selector", "unlabelled-field", "high")).unionByName(_findings(small, "selector", "tap-target", "medium"))


def focus_findings(elements: DataFrame) -> DataFrame:
    """Screens that set the order of focus by hand, and those where it leaves the order of reading: the first stop that does.

    A screen counts if all its controls have a place. Both orders are ranks
    within a screen. Stops that share a place are read in the order of focus,
    so that a tie is no departure.
    """
    control = F.col("tag").isin("input", "select", "textarea", "button", "a") | F.col("tabindex").isNotNull()
    stops = elements.where(control & ~F.coalesce("disabled", F.lit(False)))
    whole = stops.groupBy("screen").agg(F.count("*").alias("n"), F.count_if(F.col("x").isNull() | F.col("y").isNull()).alias("lost")).where("n >= 2 and lost = 0").select("screen")
    stops = stops.join(whole, "screen").withColumn("set", F.coalesce("tabindex", F.lit(0)) > 0)
    by_hand = stops.where("set").groupBy("screen").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "selector"))), lambda s: s["selector"]), ", ").alias("element"))
    tab = F.row_number().over(Window.partitionBy("screen").orderBy(F.when(F.col("set"), F.col("tabindex")).otherwise(2**31 - 1), "place", "y", "x", "selector"))
    read = F.row_number().over(Window.partitionBy("screen").orderBy(F.floor(F.col("y") / ROW + 0.5), "x", "place", "y", "tab"))
    ranks = stops.withColumn("tab", tab).select("screen", "selector", "tab", read.alias("read"))
    first = ranks.where("tab <> read").groupBy("screen").agg(F.min_by("selector", "tab").alias("element"))
    return _findings(by_hand, "element", "focus-explicit", "medium").unionByName(_findings(first, "element", "focus-order", "medium"))


def contrast_findings(samples: DataFrame) -> DataFrame:
    """Texts (screen, tag, color, background, size, weight; colours ``rrggbb``) whose contrast is too low for their size, once for each pair of colours."""
    ratio = F.floor(contrast(F.col("color"), F.col("background")) * 100 + 0.5) / 100
    large = (F.col("size") >= 24) | ((F.col("size") >= 18.66) & (F.coalesce("weight", F.lit(400)) >= 700))
    seen = samples.where("color is not null and background is not null").withColumn("ratio", ratio).withColumn("needs", F.when(large, LARGE).otherwise(NORMAL)).where("ratio < needs")
    once = seen.groupBy("tag", "color", "background").agg(F.min("screen").alias("screen"), F.min("ratio").alias("ratio"))
    return _findings(once, "tag", "contrast", F.when(F.col("ratio") < 3, "high").otherwise("medium"))


def state_findings(screens: DataFrame) -> DataFrame:
    """States (loading, error, empty) that a screen (screen, fetches, shows, loading, error, empty) needs and never had."""
    wanted = F.array(*[F.struct(F.lit(s).alias("state"), F.coalesce(F.col(need) & ~F.col(s), F.lit(False)).alias("missing"), F.lit("high" if s == "error" else "medium").alias("severity")) for s, need in (("loading", "fetches"), ("error", "fetches"), ("empty", "shows"))])
    found = screens.select("screen", F.explode(F.filter(wanted, lambda s: s["missing"])).alias("s")).select("screen", F.col("s.state").alias("element"), F.col("s.severity").alias("severity"))
    return found.select("screen", "element", F.lit("missing-state").alias("kind"), "severity")

"""Running totals over an ordered table, without a task that holds all of a group.

Rows are range partitioned by group and order. What each partition sums up to
for a group is added to all partitions after it; a group has as many such sums
as there are partitions at most. Inside a partition a window does the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import materialize

#: How totals of neighbouring partitions join.
JOINS = {"sum": F.sum, "max": F.max}


def running(rows: DataFrame, group: list[str], order: list[str], totals: dict[str, tuple[str, str]]) -> DataFrame:
    """``rows`` with a running total for each name of ``totals``: ``(column, "sum" or "max")``, over the rows of the
    same group up to this one by ``order``, itself included. Rows that are equal in group and order take any order.

    ``group`` may be empty; nulls in values count for nothing, and a total of nulls alone is null.
    """
    group = list(group)
    stored = materialize(rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    key = [*[F.col(g) for g in group], part.alias("__part")]
    sums = stored.groupBy(*key).agg(*[JOINS[how](c).alias(f"__sum_{name}") for name, (c, how) in totals.items()])
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    same = lambda a, b: a.eqNullSafe(b)
    offsets = sums.select(*[F.col(g).alias(f"__g_{g}") for g in group], F.col("__part").alias("__p"), *[JOINS[how](f"__sum_{name}").over(before).alias(f"__before_{name}") for name, (_, how) in totals.items()])
    placed = stored.withColumn("__part", part)
    on = placed["__part"] == offsets["__p"]
    for g in group:
        on = on & same(placed[g], offsets[f"__g_{g}"])
    within = Window.partitionBy(*group, "__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    joined = placed.join(offsets, on, "left")
    for name, (c, how) in totals.items():
        here, earlier = JOINS[how](c).over(within), F.col(f"__before_{name}")
        both = F.greatest(here, earlier) if how == "max" else F.coalesce(here + earlier, here, earlier)
        joined = joined.withColumn(name, both)
    return joined.select(*rows.columns, *totals)


def first_answers(log: DataFrame, key: str = "address", order: str = "seq") -> DataFrame:
    """``(address, request, response)``: each response of a log (``kind`` request or response) with the request it answers.

    A response takes the first request of its address that was made before and
    has no answer yet, and is left out if there is none; a request without an
    answer has a null response. Answers so far follow from running totals alone:
    of the responses, as many came too early as the greatest surplus of
    responses over requests so far.
    """
    asked, told = (F.col("kind") == "request").cast("long"), (F.col("kind") == "response").cast("long")
    rows = log.where(F.col("kind").isin("request", "response")).select(F.col(key).alias("address"), F.col(order).alias("seq"), asked.alias("asked"), told.alias("told"), (told - asked).alias("surplus"))
    turn = ["address"], ["seq", "told"]
    counted = running(rows, *turn, {"requests": ("asked", "sum"), "responses": ("told", "sum"), "balance": ("surplus", "sum")})
    lost = running(counted, *turn, {"early": ("balance", "max")}).withColumn("lost", F.greatest(F.lit(0), "early"))
    number = F.when(F.col("asked") == 1, F.col("requests")).otherwise(F.col("responses") - F.coalesce("lost", F.lit(0)))
    numbered = materialize(lost.withColumn("number", number).select("address", "seq", "asked", "number"))
    requests = numbered.where("asked = 1").select("address", "number", F.col("seq").alias("request"))
    # one that came too early has the number of the one before it, or none
    responses = numbered.where("asked = 0 and number > 0").groupBy("address", "number").agg(F.min("seq").alias("response"))
    return requests.join(responses, [requests["address"].eqNullSafe(responses["address"]), requests["number"] == responses["number"]], "left").select(requests["address"], "request", "response")

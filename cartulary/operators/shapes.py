"""Routes, boxes, covers and recorded steps: the joins of site and screen analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import materialize

#: Levels of nesting beyond which parents are taken to go in a circle.
MAX_LEVELS = 64


def flatten_paths(routes: DataFrame) -> DataFrame:
    """``(id, full_path, level)`` of nested routes (``id``, ``parent``, ``segment``), of any depth.

    One join a level, each over the newest level alone; routes whose parents
    lead nowhere or in a circle have no path.
    """
    front = materialize(routes.where("parent is null").select("id", F.concat(F.lit("/"), "segment").alias("full_path"), F.lit(0).alias("level")))
    found = front
    for level in range(1, MAX_LEVELS + 1):
        above = front.select(F.col("id").alias("parent"), "full_path")
        front = materialize(routes.join(above, "parent").select("id", F.concat("full_path", F.lit("/"), "segment").alias("full_path"), F.lit(level).alias("level")))
        if not front.limit(1).count():
            return found
        found = found.unionByName(front)
    raise ValueError("routes nest too deep")


def nearest_gaps(boxes: DataFrame, reach: int = 64) -> DataFrame:
    """``(screen, box, axis, gap)``: from each box to the nearest later one along each axis that overlaps it on the other.

    ``boxes`` has ``screen, box, x, y, w, h``. Gaps are above 0 and at most
    ``reach``, rounded halves up. Candidates are those that begin in the cell
    where a box ends or in the next one, so the join is on screen and cell and a
    screen with very many boxes is divided.
    """
    out = None
    for axis, start, size, across, breadth in (("y", "y", "h", "x", "w"), ("x", "x", "w", "y", "h")):
        end = F.col(start) + F.col(size)
        ends = boxes.select("screen", "box", end.alias("end"), F.col(across).alias("lo"), (F.col(across) + F.col(breadth)).alias("hi"), F.explode(F.array(F.floor(end / reach), F.floor(end / reach) + 1)).alias("cell"))
        begins = boxes.select("screen", F.col("box").alias("other"), F.col(start).alias("begin"), F.col(across).alias("lo2"), (F.col(across) + F.col(breadth)).alias("hi2"), F.floor(F.col(start) / reach).alias("cell"))
        gap = F.col("begin") - F.col("end")
        met = ends.join(begins, ["screen", "cell"]).where((F.col("box") != F.col("other")) & (gap > 0) & (gap <= reach) & (F.col("lo") < F.col("hi2")) & (F.col("lo2") < F.col("hi")))
        near = met.groupBy("screen", "box").agg(F.floor(F.min(gap) + 0.5).cast("long").alias("gap")).select("screen", "box", F.lit(axis).alias("axis"), "gap")
        out = near if out is None else out.unionByName(near)
    return out


def resolve_hops(starts: DataFrame, hops: DataFrame, most: int = 10) -> DataFrame:
    """``(start, end, hops)``: where each start leads in at most ``most`` hops; a start that does not come to rest stays itself with null hops.

    ``hops`` is ``(src, dst)``; of several hops of a source the smallest target
    counts. Only starts that still move are joined again.
    """
    one = hops.groupBy("src").agg(F.min("dst").alias("dst"))
    moving = starts.select(F.col(starts.columns[0]).alias("start")).distinct().withColumn("spot", F.col("start"))
    done = None
    for n in range(most + 1):
        step = materialize(moving.join(one, F.col("spot") == F.col("src"), "left").select("start", "spot", "dst"))
        rest = step.where("dst is null").select("start", F.col("spot").alias("end"), F.lit(n).alias("hops"))
        done = rest if done is None else done.unionByName(rest)
        moving = step.where("dst is not null").select("start", F.col("dst").alias("spot"))
        if n == most or not moving.limit(1).count():
            break
    lost = moving.select("start", F.col("start").alias("end"), F.lit(None).cast("int").alias("hops"))
    return done.unionByName(lost)


def cover_states(targets: DataFrame, live: DataFrame, redirected: DataFrame, keys: list[str], path: str) -> DataFrame:
    """``targets`` with ``state``: redirected before live before asset before uncovered."""
    flag = lambda df, name: df.select(*keys).distinct().withColumn(name, F.lit(True))
    met = targets.join(flag(redirected, "_r"), keys, "left").join(flag(live, "_l"), keys, "left")
    state = F.when(F.col("_r"), "redirected").when(F.col("_l"), "live").when(F.col(path).rlike(r"\.(?!html?$)[A-Za-z0-9]{1,5}$"), "asset").otherwise("uncovered")
    return met.select(*targets.columns, state.alias("state"))


def run_deltas(runs: DataFrame, run: str, metric: str, notes: DataFrame, note: str) -> DataFrame:
    """``(run, metric, delta, verdict, opened, closed)``: each run against the one before, with how many notes it opened and closed.

    ``runs`` has one row a run; ``notes`` says which notes a run has. A note is
    opened if the run before lacks it, and closed if the next run lacks it.
    """
    order = Window.orderBy(run)  # one row a run
    numbered = runs.select(run, F.col(metric).alias("metric"), F.lag(metric).over(order).alias("before"), F.row_number().over(order).alias("_at"))
    at = notes.select(run, note).distinct().join(numbered.select(run, "_at"), run).select("_at", note)
    shifted = at.select((F.col("_at") + 1).alias("_at"), note)
    opened = at.join(shifted, ["_at", note], "left_anti").groupBy("_at").agg(F.count("*").alias("opened"))
    closed = shifted.join(at, ["_at", note], "left_anti").groupBy("_at").agg(F.count("*").alias("closed"))
    verdict = F.when(F.col("metric") > F.col("before"), "up").when(F.col("metric") < F.col("before"), "down").when(F.col("metric") == F.col("before"), "same").otherwise("first")
    both = numbered.join(opened, "_at", "left").join(closed, "_at", "left")
    first = F.col("_at") == 1
    zero = lambda c: F.when(first, 0).otherwise(F.coalesce(c, F.lit(0))).cast("long").alias(c)
    return both.select(run, "metric", (F.col("metric") - F.col("before")).alias("delta"), verdict.alias("verdict"), zero("opened"), zero("closed"))


def recorded_steps(steps: DataFrame, usable: Column, case: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """The distinct cases of usable recorded steps, the first of each, and one row that counts steps used and skipped."""
    kept = steps.where(usable)
    first = kept.groupBy(*case).agg(F.min(order).alias(order), F.count("*").alias("times"))
    counts = steps.agg(F.count_if(usable).alias("used"), F.count_if(~F.coalesce(usable, F.lit(False))).alias("skipped"))
    return first, counts


def name_references(columns: dict[str, list[str]], least: int = 3) -> list[tuple[str, str, str, str]]:
    """``(table, column, entity, key)`` that names suggest: a column ``x_<noun>key`` or ``<noun>_id`` refers to the
    table whose name begins with the noun, by that table's own column of the noun. Works on schemas alone."""

    def noun(column: str) -> str | None:
        if column.endswith("key"):
            found = column.removesuffix("key").split("_")[-1]
        elif column.endswith("_id"):
            found = column.removesuffix("_id").split("_")[-1]
        else:
            return None
        return found if len(found) >= least else None

    keys = {(entity, n): c for entity, names in columns.items() for c in names if (n := noun(c)) and entity.startswith(n)}
    return [(name, c, entity, key) for name, names in columns.items() for c in names for (entity, n), key in keys.items() if noun(c) == n and entity != name]

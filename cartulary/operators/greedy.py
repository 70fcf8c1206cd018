"""Order-dependent greedy passes: rows come sorted by group, and only the groups' open state is held."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import materialize


def ordered_pass(df: DataFrame, group: str, order: list[str], step: Callable, schema: str) -> DataFrame:
    """Run ``step(state, row) -> (state, output row)`` over each group's rows in order.

    Groups are hashed to partitions, sorted inside them and read as a stream, so
    a group of any length costs only its state.
    """
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = object(), None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                key = getattr(row, group)
                if key != now:
                    now, state = key, None
                state, result = step(state, row)
                out.append(result)
            yield pd.DataFrame(out, columns=columns)

    return df.repartition(F.col(group)).sortWithinPartitions(group, *order).mapInPandas(run, schema)


def entity_step(threshold: float = 0.5):
    """Each row joins the first entity whose properties it resembles; an entity grows by what joins it."""

    def step(state, row):
        entities = state if state is not None else []
        props = set(row.props)
        for i, known in enumerate(entities):
            if known | props and len(known & props) / len(known | props) >= threshold:
                known |= props
                return entities, (row.id, i)
        entities.append(props)
        return entities, (row.id, len(entities) - 1)

    return step


SHAPES = "group string, seq long, endpoint string, entity long, added array<string>, conflicts array<string>"


def shape_step(threshold: float = 0.5):
    """Each shape (its properties as ``name:type``, sorted) joins the first entity that it resembles; the entity's
    properties grow, the first type of a property stays, and another one is a conflict. Postings from properties to
    entities give the candidates, so a shape is not compared with all."""

    def step(state, row):
        entities, postings = state if state is not None else ([], {})
        shape = dict(p.rsplit(":", 1) for p in row.properties)
        shared: dict[int, int] = {}
        for name in shape:
            for i in postings.get(name, ()):
                shared[i] = shared.get(i, 0) + 1
        home = min((i for i, n in shared.items() if n >= threshold * (len(entities[i]) + len(shape) - n)), default=None)
        if home is None:
            home = len(entities)
            entities.append({})
        known = entities[home]
        added = sorted(n for n in shape if n not in known)
        conflicts = [f"{n}: {known[n]} vs {t}" for n, t in sorted(shape.items()) if n in known and known[n] != t]
        for name in added:
            known[name] = shape[name]
            postings.setdefault(name, []).append(home)
        return (entities, postings), (row.group, row.seq, row.endpoint, home, [f"{n}:{shape[n]}" for n in added], conflicts)

    return step


def entities(shapes: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``(group, entity, name, seen, properties, conflicts)`` of shapes (group, seq, endpoint, properties: array of
    ``name:type``), met in the order of ``seq``: each joins the first entity with a Jaccard similarity of properties of
    ``threshold`` or more. The name is the noun that most of its endpoints end with, the first met on ties.

    The pass over a group holds its entities alone; what each shape adds is
    gathered by Spark afterwards. Shapes without properties are left out.
    """
    named = shapes.where(F.size("properties") > 0).select("group", "seq", "endpoint", F.array_sort("properties").alias("properties"))
    met = ordered_pass(named, "group", ["seq", "endpoint"], shape_step(threshold), SHAPES)
    path = F.regexp_extract("endpoint", "^[^?]*", 0)
    words = F.filter(F.split(path, "[/ ]"), lambda p: (p != "") & ~p.rlike(r"^[:{$*]|^\d+$") & ~p.rlike(r"(?i)^(api|v\d+)$"))
    noun = F.regexp_replace(F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit("entity")), "s$", "")
    each = materialize(met.withColumn("noun", noun))
    key = ["group", "entity"]
    best = each.groupBy(*key, "noun").agg(F.count("*").alias("n"), F.min("seq").alias("first")).groupBy(key).agg(F.max_by("noun", F.struct("n", -F.col("first"))).alias("name"), F.sum("n").alias("seen"))
    # an entity has as many properties as it has names
    grown = each.groupBy(key).agg(F.array_sort(F.flatten(F.collect_list(F.when(F.size("added") > 0, F.col("added"))))).alias("properties"), F.sum(F.size("conflicts")).alias("conflicts"))
    same = [best["group"].eqNullSafe(grown["group"]), best["entity"] == grown["entity"]]
    return best.join(grown, same).select(best["group"], best["entity"], "name", "seen", "properties", "conflicts")


def tolerance_step(width: float):
    """Sorted values join a bucket within ``width`` of the first value that opened it."""

    def step(state, row):
        first, number = state if state is not None else (None, -1)
        if first is None or row.value - first > width:
            first, number = row.value, number + 1
        return (first, number), (row.group, row.value, number)

    return step


def role_step(hints: dict[str, str]):
    """Names in order take the first role that is still free and whose hint they hold."""

    def step(state, row):
        free = state if state is not None else dict(hints)
        role = next((r for r, hint in free.items() if hint in row.name), None)
        if role:
            free.pop(role)
        return free, (row.group, row.name, role)

    return step


def raster_components(image: list[float], width: int) -> int:
    """Four-connected components of the cells above the image's mean."""
    mean = sum(image) / len(image)
    todo, found = {i for i, x in enumerate(image) if x > mean}, 0
    while todo:
        found += 1
        stack = [todo.pop()]
        while stack:
            i = stack.pop()
            for j in (i - width, i + width, *([i - 1] if i % width else []), *([i + 1] if (i + 1) % width else [])):
                if j in todo:
                    todo.remove(j)
                    stack.append(j)
    return found

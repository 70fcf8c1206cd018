"""Map functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def merged(first: Column, second: Column) -> Column:
    """Both maps' entries; the second's values win."""
    return F.map_concat(F.map_filter(first, lambda k, _: ~F.map_contains_key(second, k)), second)


def picked(m: Column, *keys: str) -> Column:
    return F.map_filter(m, lambda k, _: k.isin(*keys))


def omitted(m: Column, *keys: str) -> Column:
    return F.map_filter(m, lambda k, _: ~k.isin(*keys))


def inverted(m: Column) -> Column:
    """Values to keys; of keys with equal values the largest stays."""
    entries = F.array_sort(F.transform(F.map_entries(m), lambda e: F.struct(e["value"].alias("key"), e["key"].alias("value"))))
    last = F.filter(entries, lambda e, i: (i == F.size(entries) - 1) | (e["key"] != F.get(entries, i + 1)["key"]))
    return F.map_from_entries(last)


def changed(before: Column, after: Column) -> Column:
    """Keys of either map whose value differs or is missing in the other, sorted."""
    keys = F.array_union(F.map_keys(before), F.map_keys(after))
    return F.sort_array(F.filter(keys, lambda k: ~F.try_element_at(before, k).eqNullSafe(F.try_element_at(after, k)) | (F.map_contains_key(before, k) != F.map_contains_key(after, k))))

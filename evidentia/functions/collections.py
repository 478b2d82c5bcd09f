"""Lists, maps and nested values as column expressions, and plain values of configs."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def counted(items: Column) -> Column:
    """A map from each different item to how often it stands in a list; nulls don't count."""
    kept = F.filter(items, lambda x: x.isNotNull())
    return F.map_from_entries(F.transform(F.array_sort(F.array_distinct(kept)), lambda k: F.struct(k.alias("key"), F.size(F.filter(kept, lambda x: x == k)).alias("value"))))


def count_of(counts: Column, key: Column) -> Column:
    """A map's value, 0 where it has none."""
    return F.coalesce(F.try_element_at(counts, key), F.lit(0))


def merged_map(first: Column, second: Column) -> Column:
    """Both maps; where both have a key the second's value stands. A null map is empty."""
    kept = F.map_filter(first, lambda k, v: ~F.array_contains(F.map_keys(second), k))
    return F.when(first.isNull(), second).when(second.isNull(), first).otherwise(F.map_concat(kept, second))


def without_keys(values: Column, *keys: str) -> Column:
    return F.map_filter(values, lambda k, v: ~k.isin(*keys))


def best_of(pairs: Column) -> Column:
    """Of a list of (name, value), the name of the greatest value, the first of equal ones; null values don't count."""
    at = F.transform(pairs, lambda x, i: F.struct(x["value"].alias("value"), (-i).alias("place"), x["name"].alias("name")))
    return F.array_max(F.filter(at, lambda x: x["value"].isNotNull()))["name"]


def any_given(*columns: Column) -> Column:
    """Whether any is neither null nor empty."""
    return F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in columns]).isNotNull()


def as_texts(value: Column, is_list: bool) -> Column:
    """A text or a list of texts as a list without empty ones."""
    items = value if is_list else F.when(value.isNotNull(), F.array(value))
    return F.coalesce(F.filter(items, lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))


def first_valid(*columns: Column, default: int) -> Column:
    """The first that is a whole number over 0, else the default."""
    numbers = [c.cast("string").try_cast("int") for c in columns]
    return F.coalesce(*[F.when(n > 0, n) for n in numbers], F.lit(default))


def walked(value: Any, leaf: Callable[[Any], Any]) -> Any:
    """A nested value of dicts and lists with every leaf replaced."""
    if isinstance(value, dict):
        return {k: walked(v, leaf) for k, v in value.items()}
    if isinstance(value, list):
        return [walked(v, leaf) for v in value]
    return leaf(value)


def cut_texts(value: Any, limit: int = 1000) -> Any:
    """A nested value whose long texts are cut and say by how many characters."""
    return walked(value, lambda x: f"{x[:limit]}... [truncated {len(x) - limit} chars]" if isinstance(x, str) and len(x) > limit else x)

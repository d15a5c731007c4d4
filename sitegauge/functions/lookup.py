"""Small literal lookups as column expressions, so that no join is needed for them."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def map_value(key: Column, values: dict, default=None) -> Column:
    """values[key], else default. The map is a literal that Catalyst folds."""
    pairs = [F.lit(x) for item in values.items() for x in item]
    found = F.try_element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, F.lit(default) if not isinstance(default, Column) else default)


def any_of(conditions) -> Column:
    conditions = list(conditions)
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)


def contains_any(text: Column, words) -> Column:
    """True when the text holds any of the words (all lower case)."""
    return any_of(text.contains(w) for w in words)


def count_true(conditions) -> Column:
    return reduce(lambda a, b: a + b, [F.when(c, 1).otherwise(0) for c in conditions], F.lit(0))


def hits(named: dict) -> Column:
    """Array of the names whose condition holds, in the given order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in named.items()]))

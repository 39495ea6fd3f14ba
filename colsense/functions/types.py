"""Field types of categories, and of the forms of values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colsense.functions import vocab
from colsense.functions.text import trimmed, whole

BOOLEAN, INTEGER, FLOAT = "(?i)(?:true|false|yes|no|0|1)", "-?[0-9]+", r"-?[0-9]*\.[0-9]+"


def category_type(category: Column) -> Column:
    """Return the field type of a category, in any case; UNKNOWN for others."""
    table = F.create_map(*[F.lit(x) for pair in vocab.CATEGORY_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(trimmed(category))), F.lit("UNKNOWN"))


def best_type(types: Column) -> Column:
    """Return the first of the priority order that ``types`` holds; the only one it holds, if it is not in that order."""
    distinct = F.array_distinct(types)
    ranked = F.coalesce(*[F.when(F.array_contains(types, t), t) for t in vocab.TYPE_PRIORITY])
    return F.when(F.size(distinct) == 1, distinct[0]).otherwise(F.coalesce(ranked, F.lit("UNKNOWN")))


def type_of_categories(categories: Column) -> Column:
    """Return the field type of a list of categories; UNKNOWN if none has one."""
    known = F.filter(F.transform(categories, category_type), lambda t: t != "UNKNOWN")
    return F.when(F.size(known) > 0, best_type(known)).otherwise("UNKNOWN")


def value_forms(value: Column) -> dict[str, Column]:
    """Return conditions for the forms of a value that isn't blank."""
    clean = trimmed(value)
    integer = whole(clean, INTEGER)
    return {"boolean": whole(clean, BOOLEAN), "integer": integer, "long": integer & clean.try_cast("int").isNull(), "number": integer | whole(clean, FLOAT)}

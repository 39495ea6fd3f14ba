"""Metadata that users put into file names (``data[loader=csv].txt``) and column names (``type[DATE]cat[index]day``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colsense.functions import vocab
from colsense.functions.text import blank, trimmed

_BRACKET = r"\[([^\]]+)\]"


def file_metadata(name: Column) -> Column:
    """Return a struct of ``file_name`` and the fields of the first bracket of ``name``.

    A null or blank name gives nulls; without a bracket only ``file_name`` is
    set.  Of a repeated key the last counts; a count that isn't an integer is null.
    """
    content = F.regexp_extract(name, _BRACKET, 1)
    halves = F.transform(F.split(content, ","), lambda p: F.split(trimmed(p), "=", 2))
    pairs = F.transform(F.filter(halves, lambda h: F.size(h) == 2), lambda h: F.struct(F.lower(trimmed(h[0])).alias("k"), trimmed(h[1]).alias("v")))

    def field(key: str) -> Column:
        value = F.try_element_at(F.filter(pairs, lambda p: p["k"] == key), F.lit(-1))["v"]
        if not vocab.FILE_KEYS[key].startswith("number_of"):
            return value
        return F.when(value.rlike(r"\A[+-]?[0-9]+\z"), value.try_cast("int"))

    rest = F.regexp_replace(name, r"(?s)\A(.*?)\[[^\]]+\]", "$1")
    fields = [F.when(~blank(name), rest).alias("file_name")]
    fields += [F.when(~blank(name), field(k)).alias(f) for k, f in vocab.FILE_KEYS.items()]
    return F.struct(*fields)


def column_metadata(name: Column) -> Column:
    """Return a struct of ``column_name``, ``field_type`` and ``categories`` of a column's name."""
    clean = trimmed(name)
    kind = F.regexp_extract(clean, r"(?i)type\[([^\]]+)\]", 1)
    cats = F.regexp_extract(clean, r"(?i)cat\[([^\]]*)\]", 1)
    rest = trimmed(F.regexp_replace(F.regexp_replace(clean, r"(?i)type\[[^\]]+\]", ""), r"(?i)cat\[[^\]]*\]", ""))
    known = F.filter(F.transform(F.split(cats, ","), lambda c: F.lower(trimmed(c))), lambda c: c.isin(*vocab.CATEGORIES))
    return F.struct(
        F.when(blank(name), "").otherwise(F.when(rest == "", "unnamed").otherwise(rest)).alias("column_name"),
        F.when(~blank(name) & kind.isin(*vocab.FIELD_TYPES), kind).otherwise("UNKNOWN").alias("field_type"),
        F.when(blank(name), F.array().cast("array<string>")).otherwise(known).alias("categories"),
    )


def encoded_column(column_name: Column, field_type: Column, categories: Column) -> Column:
    """Write a column's name with its type and categories."""
    return F.concat(F.lit("type["), field_type, F.lit("]cat["), F.array_join(categories, ","), F.lit("]"), column_name)


def with_category(categories: Column, category: Column) -> Column:
    """Append a category."""
    return F.array_append(categories, category)

"""Predicates on single values: gender terms, job titles, kinds of digests and addresses, categories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colsense.functions import vocab
from colsense.functions.text import alternatives, blank, bordered, trimmed, whole

GENDER_TERMS = [w for words in vocab.GENDER.values() for w in words]
JOB_TERMS = [w for words in vocab.JOB_TITLES.values() for w in words.split(",")]


def is_gender(value: Column) -> Column:
    """Tell whether the trimmed value is a gender term; null and blank aren't."""
    return F.coalesce(whole(trimmed(value), "(?i)(?:" + alternatives(GENDER_TERMS) + ")"), F.lit(False))


def is_job_title(value: Column) -> Column:
    """Tell whether a job-title term stands in the value as a word; null and blank have none."""
    return F.coalesce(~blank(value) & trimmed(value).rlike("(?i)" + bordered(alternatives(JOB_TERMS))), F.lit(False))


def crypto_types(value: Column) -> Column:
    """Return the kinds of digest and address that the value has the form of, in order; none for null."""
    clean = trimmed(value)
    found = [F.when(F.char_length(value) == n, F.lit(name)) for name, n in vocab.DIGEST_LENGTHS]
    found += [F.when(whole(clean, form), F.lit(name)) for name, form in vocab.ADDRESS_FORMS]
    return F.when(value.isNull(), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*found)))


def is_category(value: Column) -> Column:
    """Tell whether the value is a known category, in any case."""
    return F.coalesce(F.lower(value).isin(*vocab.CATEGORIES), F.lit(False))

"""Text expressions that behave alike on every engine: trimming, ASCII word borders, whole matches."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\x00-\x20]"
WORD = "[A-Za-z0-9_]"


def trimmed(value: Column) -> Column:
    """Strip every character up to U+0020 from both ends."""
    return F.regexp_replace(value, rf"\A{SPACE}+|{SPACE}+\z", "")


def blank(value: Column) -> Column:
    """Tell whether ``value`` is null or has nothing but characters up to U+0020."""
    return F.coalesce(trimmed(value) == "", F.lit(True))


def whole(value: Column, pattern: str) -> Column:
    """Match all of ``value``; ``$`` would tolerate a line end."""
    return value.rlike(rf"\A(?:{pattern})\z")


def bordered(core: str, end: bool = True) -> str:
    """Put ASCII word borders around ``core``, which starts (and, with ``end``, ends) with a word character."""
    return rf"(?<!{WORD})(?:{core})" + (rf"(?!{WORD})" if end else "")


def alternatives(words: list[str]) -> str:
    """Join literal words, longer ones first, so that the longest is found."""
    return "|".join(re.escape(w).replace(r"\ ", " ").replace(r"\&", "&").replace(r"\-", "-") for w in sorted(dict.fromkeys(words), key=lambda w: (-len(w), w)))

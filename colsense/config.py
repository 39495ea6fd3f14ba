"""Thresholds and options of column classification."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Config:
    """A vote passes above its threshold; the index needs at least its confidence."""

    gender: float = 0.75
    job_title: float = 0.75
    hash: float = 0.75
    index: float = 0.7
    types: float = 0.8
    hash_types: int = 5
    sample_size: int | None = None  # rows of each column to look at; None: all
    block_size: int | None = None  # rows in a run to judge the index by; None: all
    seed: int = 0

    @classmethod
    def read(cls, path: str) -> Config:
        """Return the options in a file of ``name: value`` lines; ``#`` begins a comment, what isn't named keeps its default."""
        given = {}
        kinds = {f.name: f.type for f in fields(cls)}
        with open(path, encoding="utf-8") as lines:
            for line in lines:
                name, colon, value = line.partition("#")[0].partition(":")
                if not name.strip():
                    continue
                if not colon or name.strip() not in kinds:
                    raise ValueError(f"no such option: {line.strip()}")
                text = value.strip()
                given[name.strip()] = None if text in ("", "null") else float(text) if kinds[name.strip()] == "float" else int(text)
        return cls(**given)

"""Resolve a feed's physical column names to the logical names of the library."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F


@dataclass(frozen=True)
class Field:
    """A logical column and the physical names it may have, in order of preference."""

    name: str
    candidates: Sequence[str]
    type: str = "string"
    required: bool = True


def snake(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", name.strip().lower()).strip("_")


def resolve(columns: Sequence[str], candidates: Sequence[str], fuzzy: bool = False) -> str | None:
    """First candidate present; a fuzzy search tries exact names before part names."""
    if not fuzzy:
        return next((c for c in candidates if c in columns), None)
    by_snake = {}
    for c in columns:
        by_snake.setdefault(snake(c), c)
    wanted = [snake(c) for c in candidates]
    for w in wanted:
        if w in by_snake:
            return by_snake[w]
    for w in wanted:
        for key, original in by_snake.items():
            if w in key:
                return original
    return None


def conform(df: DataFrame, fields: Sequence[Field], fuzzy: bool = False) -> DataFrame:
    """Select the logical columns; an absent optional column becomes a typed NULL."""
    picked, missing = [], []
    for f in fields:
        physical = resolve(df.columns, f.candidates, fuzzy)
        if physical is not None:
            picked.append(F.col(f"`{physical}`").alias(f.name))
        elif f.required:
            missing.append(f.name)
        else:
            picked.append(F.lit(None).cast(f.type).alias(f.name))
    if missing:
        raise ValueError(f"no column found for {missing}; the feed has {df.columns}")
    return df.select(*picked)


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    return df

"""Joins in which a NULL source is a source like any other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """``left.join(right, keys, how)`` for left, inner and left_anti joins, with null-safe keys."""
    other = right.select(*[F.col(c).alias(f"_key_{c}" if c in keys else c) for c in right.columns])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys])
    return left.join(other, same, how).drop(*[f"_key_{k}" for k in keys])

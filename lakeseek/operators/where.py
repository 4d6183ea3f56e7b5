"""Filters given as nested dicts, compiled to a Column."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def _operator(c: Column, name: str, value: Any, strict: bool) -> Column:
    """Equality takes a missing value for null, so $ne and $nin pass on it; comparisons fail on it."""
    some = [v for v in value if v is not None] if name in ("$in", "$nin") else None
    if name in ("$in", "$nin"):
        inside = F.coalesce(c.isin(*some), F.lit(False)) if some else F.lit(False)
        inside = inside | c.isNull() if len(some) < len(value) else inside
        return inside if name == "$in" else ~inside
    same = c.isNull() if value is None else c.eqNullSafe(F.lit(value))
    made = {
        "$eq": lambda: same,
        "$ne": lambda: ~same,
        "$gt": lambda: F.coalesce(c > value, F.lit(False)),
        "$gte": lambda: F.coalesce(c >= value, F.lit(False)),
        "$lt": lambda: F.coalesce(c < value, F.lit(False)),
        "$lte": lambda: F.coalesce(c <= value, F.lit(False)),
    }.get(name)
    if made:
        return made()
    if strict:
        raise ValueError(f"unknown operator {name}")
    return F.lit(True)


def where(condition: Mapping[str, Any] | None, strict: bool = True, column: Callable[[str], Column] = F.col) -> Column:
    """True for none or {}. $and hides its siblings, and so does $or; {"$and": []} is true, {"$or": []} false. strict=False ignores unknown operators."""
    if not condition:
        return F.lit(True)
    for key, start, join in (("$and", True, lambda a, b: a & b), ("$or", False, lambda a, b: a | b)):
        if key in condition:
            out = F.lit(start)
            for part in condition[key]:
                out = join(out, where(part, strict, column))
            return out
    out = F.lit(True)
    for name, wanted in condition.items():
        tests = wanted if isinstance(wanted, Mapping) else {"$eq": wanted}
        for op, value in tests.items():
            out = out & _operator(column(name), op, value, strict)
    return out

"""Filter expressions compiled to columns."""

from __future__ import annotations

from datetime import datetime
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATORS = {
    "eq": lambda c, v: c == v, "gt": lambda c, v: c > v, "gte": lambda c, v: c >= v, "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v,
    "in": lambda c, v: c.isin(*v) if v else F.lit(False), "contains": lambda c, v: F.array_contains(c, v) if isinstance(v, (int, float)) else c.contains(v),
    "like": lambda c, v: c.like(f"%{v}%"),
}


def known(condition: Column) -> Column:
    """Null conditions are false: a row without the field does not match."""
    return F.coalesce(condition, F.lit(False))


def compile_filter(spec: dict[str, Any]) -> Column:
    """``{"and": [...]}``, ``{"or": [...]}`` and ``{field: value}`` or ``{field: {operator: value}}``, nested at will.

    Fields whose name ends in ``_at`` are compared as timestamps. No condition holds for all rows.
    """
    parts = []
    for field, want in spec.items():
        if field in ("and", "or"):
            parts.append(reduce(lambda a, b: a & b if field == "and" else a | b, map(compile_filter, want)))
            continue
        col = F.col(field)
        for op, value in (want if isinstance(want, dict) else {"in" if isinstance(want, (list, tuple)) else "eq": want}).items():
            if op not in OPERATORS:
                raise ValueError(f"no operator {op!r} for {field!r}")
            if field.endswith("_at") and isinstance(value, str):
                value = F.lit(datetime.fromisoformat(value))
                col = col.cast("timestamp_ntz")
            parts.append(known(OPERATORS[op](col, value)))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def compile_tags(tags: str, spec: dict[str, Any], scopes: list[str] | None = None, scope_key: str = "scope") -> Column:
    """Conditions on a map of strings: a scalar (equal as text), ``$contains``, ``$exists``, ``$in``; one operator a key.

    An empty ``$in`` or an empty list of scopes gives no rows. Keys ``scope`` and ``read_scopes`` are not conditions.
    """
    parts = [F.lit(False) if not scopes else known(F.try_element_at(tags, F.lit(scope_key)).isin(*scopes))] if scopes is not None else []
    for key, want in spec.items():
        if key in ("scope", "read_scopes"):
            continue
        value = F.try_element_at(F.col(tags), F.lit(key))
        if not isinstance(want, dict):
            parts.append(known(value == (str(want).lower() if isinstance(want, bool) else str(want))))
            continue
        if len(want) != 1:
            raise ValueError(f"one operator for {key!r}")
        op, arg = next(iter(want.items()))
        ways = {"$contains": lambda: known(value.contains(str(arg))), "$exists": lambda: F.map_contains_key(F.col(tags), key) == F.lit(bool(arg)), "$in": lambda: known(value.isin(*map(str, arg))) if arg else F.lit(False)}
        if op not in ways:
            raise ValueError(f"no operator {op!r}")
        parts.append(known(ways[op]()))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def phrase_range(text: Column, now: Column) -> Column:
    """The time span that a phrase such as "last 3 days" names, as a struct of start and stop; null without one.

    The first of the phrases in this order counts. Weeks start on Monday; a last month is 30 days.
    """
    low, day = F.lower(text), F.date_trunc("day", now)
    number = lambda unit: F.regexp_extract(low, rf"last (\d+) {unit}s?", 1).cast("int")
    back = lambda days: now - F.make_dt_interval(days=days)
    span = lambda a, b: F.struct(a.alias("start"), b.alias("stop"))
    end = lambda d: d + F.expr("INTERVAL '23:59:59.999999' HOUR TO SECOND")
    one = F.expr("INTERVAL '1' DAY")
    return (
        F.when(low.contains("today"), span(day, end(day)))
        .when(low.contains("yesterday"), span(day - one, end(day - one)))
        .when(low.rlike(r"last \d+ days?"), span(back(F.when(low.rlike(r"last \d+ days?"), number("day"))), now))
        .when(low.rlike("last week"), span(back(F.lit(7)), now))
        .when(low.contains("this week"), span(F.date_trunc("week", now), now))
        .when(low.rlike("last month"), span(back(F.lit(30)), now))
        .when(low.contains("this month"), span(F.date_trunc("month", now), now))
        .when(low.rlike(r"last \d+ weeks?"), span(back(F.when(low.rlike(r"last \d+ weeks?"), number("week") * 7)), now))
        .when(low.rlike(r"last \d+ months?"), span(back(F.when(low.rlike(r"last \d+ months?"), number("month") * 30)), now))
    )

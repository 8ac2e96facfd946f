"""Small helpers for writing the checking SQL: output casts and conditional sums."""

from __future__ import annotations


def n(expression: str, name: str) -> str:
    """Whole number."""
    return f"CAST({expression} AS BIGINT) AS {name}"


def x(expression: str, name: str) -> str:
    """Money, average or ratio."""
    return f"round(CAST({expression} AS DOUBLE), 6) AS {name}"


def d(expression: str, name: str) -> str:
    """Date."""
    return f"CAST({expression} AS VARCHAR) AS {name}"


def tally(cond: str) -> str:
    """Rows that match, NULL if none does."""
    return f"nullif(count(*) FILTER (WHERE {cond}), 0)"


def tally0(cond: str) -> str:
    """Rows that match, 0 if none does, NULL over no rows at all."""
    return f"CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE {cond}) END"


def total(cond: str, value: str) -> str:
    """Sum over rows that match, NULL if none does."""
    return f"sum({value}) FILTER (WHERE {cond})"


def total0(cond: str, value: str) -> str:
    """Sum over rows that match, 0 if none does, NULL over no rows or only NULL values."""
    return (f"CASE WHEN count(*) FILTER (WHERE ({cond}) IS NOT TRUE) > 0 "
            f"THEN coalesce(sum({value}) FILTER (WHERE {cond}), 0) "
            f"ELSE sum({value}) FILTER (WHERE {cond}) END")


def quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def columns(*parts: str) -> str:
    return ",\n       ".join(parts)

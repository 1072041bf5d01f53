"""Headcount and budget expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadlane.functions.text import SPACE, let, strip, to_str

# Patterns.
_RANGE = rf"(\d+){SPACE}*-{SPACE}*(\d+)"
_APPROX = rf"~{SPACE}*(\d+)"
_PLUS = rf"(\d+){SPACE}*\+"
_FIRST = r"(\d+)"
_PER_MO = rf"(?U)/{SPACE}*mo(?:nth)?\b"
_PER_MONTH = rf"(?U)\bper{SPACE}*month\b"
_AMOUNT = r"(\d+(?:\.\d+)?)"
_BUDGET_RANGE = rf"^{_AMOUNT}{SPACE}*k?{SPACE}*-{SPACE}*{_AMOUNT}{SPACE}*k?$"
_BUDGET_SINGLE = rf"^{_AMOUNT}{SPACE}*k?$"


def _number(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).try_cast("double")


def employees(cell: Column) -> Column:
    """Headcount: midpoint of a range, else ~n, else n+, else the first number. ``coalesce`` stops at the first."""
    middle = (_number(cell, _RANGE, 1) + _number(cell, _RANGE, 2)) / 2
    return F.coalesce(
        F.when(cell.contains("-"), middle),
        F.when(cell.contains("~"), _number(cell, _APPROX)),
        F.when(cell.contains("+"), _number(cell, _PLUS)),
        _number(cell, _FIRST),
    )


def parse_employees(raw: Column) -> Column:
    return let(to_str(raw), employees)


def budget_text(cell: Column) -> Column:
    """Budget text without currency sign, thousands separators and per-month suffix."""
    text = F.translate(F.lower(cell), "$,", "")
    text = F.regexp_replace(text, _PER_MO, "")
    return strip(F.regexp_replace(text, _PER_MONTH, ""))


def budget(text: Column) -> Column:
    """Monthly amount of a ``budget_text``; a k on either end of a range counts for both ends."""
    scale = F.when(text.contains("k"), 1000.0).otherwise(1.0)
    low, high = _number(text, _BUDGET_RANGE, 1), _number(text, _BUDGET_RANGE, 2)
    return F.coalesce(
        F.when(text.contains("-"), (low * scale + high * scale) / 2),
        _number(text, _BUDGET_SINGLE) * scale,
    )


def parse_budget(raw: Column) -> Column:
    return let(let(to_str(raw), budget_text), budget)

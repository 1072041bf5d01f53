"""Date expression.

A cell is reduced to three tokens (``date_text``, ``date_tokens``), these to numbers (``date_parts``), and the
numbers are read as year, month and day (``date_order``, ``date_of``). A plan computes the steps in projections
of their own. Texts with fewer than three parts have no date of their own and give null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlane.functions.build import built_once
from leadlane.functions.text import SPACE, let, to_str

# Names and shapes.
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_MONTH_NAME = (
    "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|"
    "sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
)
_WEEKDAY = (
    r"^(?:mon(?:day)?|tue(?:sday)?|wed(?:nesday)?|thu(?:rsday)?|fri(?:day)?|sat(?:urday)?|sun(?:day)?)[,.]?"
    + SPACE + "+"
)
# A possible time of day: 24 hours with minutes, or 12 hours with or without them; then perhaps a zone.
_AM_PM = SPACE + r"*[ap]\.?m\b\.?"
_SIXTY = r":[0-5]\d"
_CLOCK = rf"(?:(?:0?\d|1[0-2])(?:{_SIXTY}(?:{_SIXTY}(?:[.,]\d+)?)?)?{_AM_PM}|(?:[01]?\d|2[0-3]){_SIXTY}(?:{_SIXTY}(?:[.,]\d+)?)?)"
_ZONES = "z|utc|gmt|est|edt|cst|cdt|mst|mdt|pst|pdt|bst|cet|cest|eet|eest|wet|west|ist|jst|aest|aedt"
_ZONE = rf"(?:{SPACE}*(?:{_ZONES})\b)?(?:{SPACE}*[+-]\d{{2}}:?\d{{2}})?"
_TIME = rf"(?:(?:^|,|{SPACE})(?:{SPACE}*at{SPACE}+)?{SPACE}*|(?<=\d)t){_CLOCK}{_ZONE}(?={SPACE}|,|$)"
_ISO = r"^\d{4}-\d{1,2}-\d{1,2}$"
_NUMBER = r"\d{1,2}|\d{4}"
_THREE_TOKENS = rf"^(?:{_NUMBER}|{_MONTH_NAME})/(?:{_NUMBER}|{_MONTH_NAME})/(?:{_NUMBER}|{_MONTH_NAME})$"
_PLAIN = r"^\d{1,4}[-/]\d{1,2}[-/]\d{1,4}$"
_ORDINAL = r"(?<=\d)(?:st|nd|rd|th)\b"
_BREAK = rf"(?:{SPACE}|[,./-])+(?:of{SPACE}+)?|(?<=\d)(?=[a-z])|(?<=[a-z])(?=\d)"
_COMPACT = r"^(\d{4})(\d{2})(\d{2})$"

# Hyphenated texts other than plain ISO dates are read day first, also when the year leads.
HYPHEN_IS_DAY_FIRST = True
# Two-digit years belong to the century that puts them within this many years of today.
CENTURY_WINDOW = 50


def date_text(cell: Column) -> Column:
    """The parts of a date as ``a/b/c``, lower case, without weekday, time and ordinal endings."""
    text = F.btrim(F.regexp_replace(F.regexp_replace(F.lower(cell), _WEEKDAY, ""), _TIME, ""))
    text = F.regexp_replace(text, _COMPACT, "$1/$2/$3")
    general = F.regexp_replace(F.regexp_replace(text, _ORDINAL, ""), _BREAK, "/")
    return F.when(cell.rlike(_PLAIN), F.translate(cell, "-", "/")).otherwise(general)


def date_tokens(text: Column) -> Column:
    """Array of the three parts; shorter unless each is a number of usable length or a month name."""
    return F.split(F.regexp_extract(text, _THREE_TOKENS, 0), "/")


def is_day_first(cell: Column) -> Column:
    return F.lit(HYPHEN_IS_DAY_FIRST) & cell.contains("-") & ~cell.rlike(_ISO)


def date_parts(tokens: Column) -> Column:
    """Struct of the three tokens as numbers, with the position of a month name (0 for none)."""
    part = [F.get(tokens, F.lit(i)) for i in range(3)]

    def is_name(token: Column) -> Column:
        return token >= "a"

    def number(token: Column) -> Column:
        month = (F.instr(F.lit(_MONTHS), F.substring(token, 1, 3)) + 2) / 3
        return F.when(is_name(token), month.cast("int")).otherwise(token.try_cast("int"))

    named = F.when(is_name(part[0]), 1).when(is_name(part[1]), 2).when(is_name(part[2]), 3).otherwise(0)
    lengths = [F.octet_length(token) == 4 for token in part]
    full_year = ((named != 1) & lengths[0]) | ((named != 2) & lengths[1]) | ((named != 3) & lengths[2])
    return F.when(
        F.size(tokens) == 3,
        F.struct(
            *[number(token).alias(name) for token, name in zip(part, "abc")],
            named.alias("named"),
            ((named != 1) & lengths[0]).alias("year_leads"),
            full_year.alias("full_year"),
        ),
    )


def date_order(parts: Column, day_first: Column) -> Column:
    """Struct of ``y``, ``m`` and ``d``: which of the three parts is which."""
    a, b, c, named = parts["a"], parts["b"], parts["c"], parts["named"]

    def ymd(y: Column, m: Column, d: Column) -> Column:
        return F.struct(y.alias("y"), m.alias("m"), d.alias("d"), parts["full_year"].alias("full_year"))

    return (
        F.when(parts.isNull(), None)
        .when(named == 1, F.when(b > 31, ymd(b, a, c)).otherwise(ymd(c, a, b)))
        .when(named == 2, F.when(a > 31, ymd(a, b, c)).otherwise(ymd(c, b, a)))
        .when(named == 3, F.when(b > 31, ymd(b, c, a)).otherwise(ymd(a, c, b)))
        .when((a > 31) | parts["year_leads"], F.when(day_first & (c <= 12), ymd(a, c, b)).otherwise(ymd(a, b, c)))
        .when((a > 12) | (day_first & (b <= 12)), ymd(c, b, a))
        .otherwise(ymd(c, a, b))
    )


def date_of(order: Column) -> Column:
    """The date of an order struct; impossible dates give null."""
    today = F.year(F.current_date())
    near = order["y"] + today - today % 100
    year = (
        F.when(order["full_year"], order["y"])
        .when(near >= today + CENTURY_WINDOW, near - 100)
        .when(near < today - CENTURY_WINDOW, near + 100)
        .otherwise(near)
    )
    possible = order["m"].between(1, 12) & order["d"].between(1, 31)
    zero = F.lit(0)
    return F.when(possible, F.try_make_timestamp(year, order["m"], order["d"], zero, zero, zero).cast("date"))


@built_once
def _steps(cell: str) -> dict[str, Column]:
    return {
        "date_tokens": date_tokens(date_text(F.col(cell))),
        "date_parts": date_parts(F.col("date_tokens")),
        "date_order": date_order(F.col("date_parts"), is_day_first(F.col(cell))),
    }


def add_date(df: DataFrame, cell: str, name: str) -> DataFrame:
    """Add the date of a cell column, one step per projection."""
    steps = _steps(cell)
    for step, column in steps.items():
        df = df.withColumn(step, column)
    return df.withColumn(name, _date_of_order()).drop(*steps)


@built_once
def _date_of_order() -> Column:
    return date_of(F.col("date_order"))


def parse_date(raw: Column) -> Column:
    """The same as one expression, for use outside a plan of one's own."""
    return let(
        to_str(raw),
        lambda cell: let(
            let(date_tokens(date_text(cell)), date_parts),
            lambda parts: let(date_order(parts, is_day_first(cell)), date_of),
        ),
    )

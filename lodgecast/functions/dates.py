"""Reservation dates arrive in mixed formats; unreadable ones become null.

A text is brought into the form year-month-day and read once. Its steps are columns of their own
that are referred to more than once, which keeps the optimiser from copying them into each other,
and the date comes out of a one-element array, so a filter on it stays above and holds no second
copy. That way the generated code is small enough to be compiled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The shapes that are read.
YEAR_FIRST = r"^\d{4}([-/.])\d{1,2}\1\d{1,2}$"
YEAR_LAST = r"^\d{1,2}(([-/.])\d{1,2}\2\d{4}|([-/])\d{1,2}\3\d{2})$"
DIGITS = r"^\d{8}$"
_SHORT = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
_LONG = "january|february|march|april|june|july|august|september|october|november|december"
MONTH_FIRST = rf"(?i)^({_SHORT}|{_LONG}) \d{{1,2}},? \d{{4}}$"
MONTH_SECOND = rf"(?i)^\d{{1,2}}( ({_SHORT}|{_LONG}) \d{{4}}|-({_SHORT})-(\d{{2}}|\d{{4}}))$"
LAST_SHORT_YEAR = 68  # two digits stand for 1969 to 2068
# A time of day behind the date; it is checked and left away.
CLOCK = r"[ T]([01]?\d|2[0-3]):[0-5]\d(:[0-5]\d([.]\d{1,9})?)?$"


_TEXT, _PARTS = "_date_text", "_date_parts"


def with_date(df: DataFrame, column: str, name: str = "reservation_date") -> DataFrame:
    """Add ``name``: the date of a mixed-format string, null when it is none. Day first only if
    month first fails."""
    trimmed = f"trim(`{column}`)"
    text = f"if(instr({trimmed}, ':') > 0, regexp_replace({trimmed}, r'{CLOCK}', ''), {trimmed})"
    first, second, year = (f"{_PARTS}[{i}]" for i in range(3))
    year = f"if(length({year}) = 2, concat(if({year} > '{LAST_SHORT_YEAR}', '19', '20'), {year}), {year})"

    def month(part: str) -> str:
        return f"(instr('{_SHORT.replace('|', '')}', lower(left({part}, 3))) + 2) div 3"

    def date(*parts: str) -> str:
        return f"try_cast(concat_ws('-', {', '.join(parts)}) AS DATE)"

    read = F.expr(
        f"""CASE
        WHEN {_TEXT} RLIKE r'{YEAR_FIRST}' THEN try_cast(translate({_TEXT}, '/.', '--') AS DATE)
        WHEN {_TEXT} RLIKE r'{YEAR_LAST}' THEN coalesce({date(year, first, second)}, {date(year, second, first)})
        WHEN {_TEXT} RLIKE r'{DIGITS}' THEN {date(*(f"substr({_TEXT}, {i}, {n})" for i, n in ((1, 4), (5, 2), (7, 2))))}
        WHEN {_TEXT} RLIKE r'{MONTH_FIRST}' THEN {date(year, month(first), second)}
        WHEN {_TEXT} RLIKE r'{MONTH_SECOND}' THEN {date(year, month(second), first)}
        END"""
    )
    steps = df.select("*", F.expr(text).alias(_TEXT)).select("*", F.expr(f"split({_TEXT}, '[-/., ]+')").alias(_PARTS))
    kept = [F.col(f"`{c}`") for c in df.columns if c != name]
    return steps.select(*kept, F.explode(F.array(read)).alias(name))

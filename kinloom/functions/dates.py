"""Birth dates as closed windows of days, and how well two windows agree; built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

THIS_YEAR = 2026
# Evidence of a window by precision.
PRECISION = {"day": 1.0, "month": 0.85, "year": 0.70, "approx-year": 0.58}
_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
_NAMES = "january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec"


_APPROX, _AGE = r"^(?:approx\.?|c\.?|circa|ca\.?)\s*(\d{4})$", r"^age\s*(?:approx\.?)?\s*(\d{1,3})$"
_ISO, _NUMBERS = r"^(\d{4})-(\d{1,2})-(\d{1,2})$", r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})$"
_LONG, _MONTH_YEAR, _YEAR = rf"^({_NAMES})\s+(\d{{1,2}}),\s*(\d{{4}})$", rf"^({_NAMES})\s+(\d{{4}})$", r"^(\d{4})$"


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def window_sql(column: str) -> str:
    """The ladder of readings as one SQL expression over ``column``; the first pattern that fits decides."""
    group = lambda p, i: f"regexp_extract(t, r'{p}', {i})"
    day = lambda y, m, d: f"try_to_date(concat_ws('-', lpad({y}, 4, '0'), lpad({m}, 2, '0'), lpad({d}, 2, '0')), 'yyyy-MM-dd')"
    month = lambda p: f"cast(array_position(array({', '.join(repr(m) for m in _MONTHS)}), substring({group(p, 1)}, 1, 3)) as string)"
    window = lambda lo, hi, p: f"if({lo} is not null and year({lo}) >= 1, named_struct('lo', {lo}, 'hi', {hi}, 'precision', '{p}'), null)"

    def years(y: str, slack: int, precision: str) -> str:
        return _let(y, "y", f"if(y - {slack} >= 1 and y + {slack} <= 9999, named_struct('lo', make_date(y - {slack}, 1, 1), 'hi', make_date(y + {slack}, 12, 31), 'precision', '{precision}'), null)")

    year = lambda p, i: f"try_cast({group(p, i)} as int)"
    whole, named, first = day(group(_ISO, 1), group(_ISO, 2), group(_ISO, 3)), day(group(_LONG, 3), month(_LONG), group(_LONG, 2)), day(group(_MONTH_YEAR, 2), month(_MONTH_YEAR), "'1'")
    readings = f"filter(array({day(group(_NUMBERS, 3), group(_NUMBERS, 2), group(_NUMBERS, 1))}, {day(group(_NUMBERS, 3), group(_NUMBERS, 1), group(_NUMBERS, 2))}), z -> z is not null)"
    numbers = _let(readings, "r", f"case size(r) when 2 then {window('array_min(r)', 'array_max(r)', 'month')} when 1 then {window('r[0]', 'r[0]', 'day')} else {years(year(_NUMBERS, 3), 0, 'year')} end")
    ladder = [
        (_APPROX, years(year(_APPROX, 1), 1, "approx-year")), (_AGE, years(f"{THIS_YEAR} - {year(_AGE, 1)}", 1, "approx-year")),
        (_ISO, _let(whole, "d", f"coalesce({window('d', 'd', 'day')}, {years(year(_ISO, 1), 0, 'year')})")), (_NUMBERS, numbers),
        (_LONG, _let(named, "d", window("d", "d", "day"))), (_MONTH_YEAR, _let(first, "d", window("d", "last_day(d)", "month"))), (_YEAR, years(year(_YEAR, 1), 0, "year")),
    ]
    return _let(f"lower(trim(coalesce({column}, '')))", "t", "case " + " ".join(f"when t rlike r'{p}' then {w}" for p, w in ladder) + " end")


def date_window(column: str) -> Column:
    """``struct<lo, hi, precision>`` of a column by name; null for blanks and anything unread."""
    return F.expr(window_sql(column))


def midpoint(w: Column) -> Column:
    return F.date_add(w["lo"], F.floor(F.datediff(w["hi"], w["lo"]) / 2).cast("int"))


def weight(w: Column) -> Column:
    out = F.lit(0.0)
    for p, v in PRECISION.items():
        out = F.when(w["precision"] == p, v).otherwise(out)
    return out


def birth_signal(a: Column, b: Column) -> tuple[Column, Column]:
    """Score and weight of two windows; nothing where one is missing."""
    both = a.isNotNull() & b.isNotNull()
    overlap = (a["lo"] <= b["hi"]) & (b["lo"] <= a["hi"])
    gap = F.abs(F.datediff(midpoint(a), midpoint(b)))
    half = F.when((a["precision"] == "day") & (b["precision"] == "day"), 120.0).otherwise(400.0)
    score = F.when(~both, 0.0).when(overlap, 100.0).otherwise(100.0 * F.pow(F.lit(0.5), gap / half))
    return score, F.when(both, F.least(weight(a), weight(b))).otherwise(0.0)

"""Calendar columns of a date or timestamp."""

from __future__ import annotations

import math

from tideline.operators.parts import Step

# Cycle lengths of the circular encodings.
MONTHS, WEEKDAYS, YEAR_DAYS = 12.0, 7.0, 365.25


def _circle(name: str, part: str, length: float) -> dict[str, str]:
    angle = f"{2.0 * math.pi!r}D * {part} / {length!r}D"
    return {f"{name}_sin": f"sin({angle})", f"{name}_cos": f"cos({angle})"}


def calendar(time: str, time_type: str = "timestamp") -> Step:
    day = f"to_date(to_timestamp(`{time}`))" if time_type == "string" else f"to_date(`{time}`)"
    month, last = f"month({day})", f"{day} = last_day({day})"
    first_of_quarter = f"day({day}) = 1 AND {month} % 3 = 1"
    flags = {
        "is_month_start": f"day({day}) = 1",
        "is_month_end": last,
        "is_quarter_start": first_of_quarter,
        "is_quarter_end": f"{last} AND {month} % 3 = 0",
        "is_year_start": f"dayofyear({day}) = 1",
        "is_year_end": f"{month} = 12 AND day({day}) = 31",
    }
    return Step(
        features={
            "year": f"year({day})",
            "month": month,
            "day": f"day({day})",
            "day_of_week": f"weekday({day})",
            "day_of_year": f"dayofyear({day})",
            "week_of_year": f"weekofyear({day})",
            "quarter": f"quarter({day})",
            **_circle("month", month, MONTHS),
            **_circle("day_of_week", f"weekday({day})", WEEKDAYS),
            **_circle("day_of_year", f"dayofyear({day})", YEAR_DAYS),
            **{name: f"CAST({flag} AS INT)" for name, flag in flags.items()},
        }
    )

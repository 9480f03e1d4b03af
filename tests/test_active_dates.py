"""Service days of several ranges, odd exceptions and many of them, against brute force; what is shuffled."""

import random
from datetime import date, timedelta

from shuffles import rows_shuffled

from timetide.operators import intervals

CALENDAR = "service_id long, start_date date, end_date date, " + ", ".join(f"{d} int" for d in intervals.WEEKDAYS)
EXCEPTIONS = "service_id long, date date, exception_type int"


def _days(calendar, exceptions):
    out = {(s, a + timedelta(i)) for s, a, b, *runs in calendar if a and b for i in range((b - a).days + 1) if runs[(a + timedelta(i)).weekday()] == 1}
    out |= {(s, d) for s, d, kind in exceptions if kind == 1}
    return out - {(s, d) for s, d, kind in exceptions if kind == 2 and s is not None and d is not None}


def test_days_against_brute_force(spark):
    draw = random.Random("days")
    first = date(2024, 2, 20)
    any_day = lambda: first + timedelta(draw.randrange(150))
    calendar, exceptions = [], []
    for service in [None, *range(40)]:
        for _ in range(draw.choice([0, 1, 1, 1, 2, 3])):
            a, b = any_day(), any_day()
            calendar.append((service, draw.choice([a, a, a, a, None]), b, *[draw.choice([0, 1, 1, None]) for _ in range(7)]))
        for _ in range(draw.choice([0, 1, 3, 10, 130])):
            exceptions.append((service, draw.choice([any_day(), any_day(), any_day(), None]), draw.choice([1, 1, 2, 3, None])))
    found = intervals.active_dates(spark.createDataFrame(calendar, CALENDAR), spark.createDataFrame(exceptions, EXCEPTIONS))
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == _days(calendar, exceptions)
    assert len(got) > 500 and any(s is None for s, _ in got) and any(d is None for _, d in got)


def test_days_are_not_shuffled(spark):
    calendar = [(s, date(2020, 1, 1), date(2023, 1, 1), 1, 1, 1, 1, 1, 0, 0) for s in range(30)]
    exceptions = [(s, date(2020, 6, 1) + timedelta(s), 1 + s % 2) for s in range(30)]
    found = intervals.active_dates(spark.createDataFrame(calendar, CALENDAR), spark.createDataFrame(exceptions, EXCEPTIONS))
    assert {tuple(r) for r in found.collect()} == _days(calendar, exceptions)
    assert rows_shuffled(found) <= len(calendar) + len(exceptions)

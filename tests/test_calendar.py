"""Service days of whole ranges against brute force."""

from datetime import date, timedelta

import __spark_entry__


def test_whole_ranges_are_expanded(spark, tmp_path):
    rows = [(1, date(2020, 1, 1), "F"), (1, date(2020, 1, 4), "F"), (1, date(2020, 7, 1), "O"), (1, date(2020, 8, 12), "F"), (1, date(2020, 8, 12), "P"), (1, date(2021, 2, 6), "F"), (2, date(2020, 3, 2), "O"), (3, date(2020, 3, 7), "F")]
    spark.createDataFrame(rows, "o_custkey long, o_orderdate date, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    wanted = set()
    for key in {k for k, _, _ in rows}:
        own = [(d, s) for k, d, s in rows if k == key]
        first, last = min(own)[0], max(own)[0]
        days = {first + timedelta(i) for i in range((last - first).days + 1)}
        days = {d for d in days if d.weekday() < 5} | {d for d, s in own if s == "F"}
        wanted |= {(key, d) for d in days - {d for d, s in own if s != "F"}}
    got = [tuple(r) for r in __spark_entry__.queries()["q_calendar_expand_full"](spark, str(tmp_path)).collect()]
    assert len(got) == len(wanted) and set(got) == wanted

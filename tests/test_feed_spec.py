"""Spec checks on agencies' time zones and on continuous service: what reports, and what must not."""

from datetime import date

import pytest
from test_feed import BASE

from timetide.plans import notices as N
from timetide.plans.config import Config
from timetide.plans.engine import Run
from timetide.sources.feed import from_texts

RULES = ["AGN_004", "RTS_028", "TRP_019"]
AGENCY = "agency_id,agency_name,agency_url,agency_timezone\nlake,Lake Lines,https://lake.example,"
ROUTES = "route_id,agency_id,route_short_name,route_type,continuous_pickup\nferry,lake,F,4,"
FLEX = "trip_id,stop_id,stop_sequence,start_pickup_drop_off_window,end_pickup_drop_off_window,continuous_drop_off\nnoon,pier_n,1,08:00:00,09:00:00,\nnoon,pier_s,2,08:00:00,09:00:00,"


@pytest.mark.parametrize(
    ("files", "expected"),
    [
        ({"agency.txt": AGENCY + "\n"}, "AGN_004"),
        ({"agency.txt": AGENCY + "UTC+3\n2,B,http://b.example, Europe/Istanbul \n"}, "AGN_004"),
        ({"agency.txt": AGENCY + "Europe/Istanbul\n", "routes.txt": ROUTES + "1\n", "stop_times.txt": FLEX + "1\n"}, ""),
        ({"routes.txt": ROUTES + "2\n", "stop_times.txt": FLEX + "\n"}, "RTS_028 TRP_019"),
        ({"routes.txt": ROUTES + "0\n"}, "TRP_019"),
        ({"stop_times.txt": FLEX + "3\n"}, "TRP_019"),
    ],
)
def test_spec_checks(spark, files, expected):
    run = Run(from_texts(spark, BASE | files), Config(today=date(2026, 5, 15)))
    found = run.notices(RULES)
    assert sorted(r.rule_id for r in found.select("rule_id").distinct().collect()) == expected.split()
    if "AGN_004" in expected:
        assert not N.publishable(found, run.rule_table()).first()["publishable"]

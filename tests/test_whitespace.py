"""Findings that only blanks around cells make are left out and counted under DQ_016."""

from datetime import date

from test_feed import BASE

from timetide.plans.config import Config
from timetide.plans.engine import Run
from timetide.sources.feed import from_texts

TODAY = date(2026, 5, 15)


def notices(spark, files, rules):
    run = Run(from_texts(spark, BASE | files), Config(today=TODAY))
    rows = run.notices(rules.split()).collect()
    run.close()
    found = sorted((r.rule_id, r.entity_id, r.line) for r in rows if r.rule_id != "DQ_016")
    return found, {r.file: (r.suppressed, r.suppressed_rules) for r in rows if r.rule_id == "DQ_016"}


def test_padded_values_are_judged_without_blanks(spark):
    """A padded number, time and type are malformed only by their blanks; a word is wrong with and without them."""
    files = {
        "stops.txt": "stop_id,stop_name,stop_lat,stop_lon\npier_n,North Pier, 47.62 ,9.18\npier_s,South Pier,47.52,9.31 \npier_e,East Pier, north ,9.42\n",
        "routes.txt": "route_id,agency_id,route_long_name,route_type\nferry,lake,Crossing, 4\ntram,lake,Shore Line,99 \n",
    }
    found, roots = notices(spark, files, "STP_004 STP_005 RTS_004 DQ_016")
    assert found == [("RTS_004", "tram", 3), ("STP_004", None, None)]
    assert roots == {"stops.txt": (2, "STP_004, STP_005"), "routes.txt": (1, "RTS_004")}


def test_keys_that_are_there_but_for_blanks(spark):
    files = {"trips.txt": "route_id,service_id,trip_id\n ferry,daily,noon\nferry,daily ,night\nlost ,weekend,shore\n"}
    found, roots = notices(spark, files, "TRP_002 TRP_003 RTS_012 DQ_016")
    # No trip names the tram; `lost` is no route, with or without blanks.
    assert found == [("RTS_012", "tram", 3), ("TRP_002", "shore", 4)]
    assert roots == {"trips.txt": (2, "TRP_002, TRP_003")}


def test_nothing_goes_without_a_root(spark):
    """Blanks are in the parents' file: the children's file has no DQ_016 that could tell of them, so the findings stay."""
    files = {"routes.txt": "route_id,agency_id,route_long_name,route_type\nferry ,lake,Crossing,4\ntram,lake,Shore Line,0\n"}
    found, roots = notices(spark, files, "TRP_002 RTS_012 DQ_016")
    assert found == [("TRP_002", "night", 3), ("TRP_002", "noon", 2)]
    assert roots == {"routes.txt": (1, "RTS_012")}
    found, roots = notices(spark, {"stops.txt": BASE["stops.txt"].replace("47.62", " 47.62")}, "STP_004")
    assert found == [("STP_004", None, None)] and roots == {}


def test_clean_feed(spark):
    assert notices(spark, {}, "STP_004 TRP_002 TRP_003 RTS_012 DQ_016") == ([], {})

"""Whole notices of rules that look values up in any table, at stations beside stops, and at headsigns."""

from datetime import date

from test_feed import BASE

from timetide.plans.config import Config
from timetide.plans.engine import Run
from timetide.sources.feed import from_texts

TODAY = date(2026, 5, 15)


def whole(spark, files, rules):
    run = Run(from_texts(spark, BASE | files), Config(today=TODAY))
    found = sorted(((r.rule_id, r.entity_id, r.line, r.field, r.observed_value) for r in run.notices(rules.split()).collect()), key=str)
    run.close()
    return found


def test_translations_of_values_and_records(spark):
    head = "table_name,field_name,language,translation,record_id,record_sub_id,field_value\n"
    rows = [
        "stops,stop_name,de,Nordsteg,,,North Pier",  # there
        "stops,stop_name,de,Weststeg,,,West Pier",  # nowhere
        "stops,stop_name,fr,Ponton,,,West Pier",  # the same value again
        "stops,stop_name,de,x,,,north pier",  # letters count
        "stops,stop_desc,de,x,,,anything",  # no such column in the file
        "levels,level_name,de,x,,,Ground",  # no such file
        "trips,trip_id,de,x,,,noon",
        "routes,route_long_name,de,Querung,ferry,,",
        "routes,route_long_name,de,Nichts,gone,,",
        "agency,agency_name,de,Nichts,gone,,",
        "agency,agency_name,fr,Rien,gone,,",
        "stops,colour,de,x,pier_n,,",  # no field of the format
        "feed_info,feed_publisher_name,de,x,,,",
    ]
    files = {"translations.txt": head + "\n".join(rows) + "\n"}
    assert whole(spark, files, "TRN_002 TRN_016 XFL_014 XFL_016") == [
        ("TRN_002", "pier_n", 13, "field_name", "colour"),
        ("TRN_016", None, None, "field_value", "2"),
        ("XFL_014", None, None, "record_id", "2"),
        ("XFL_016", None, None, "table_name", "1"),
    ]
    clean = {"translations.txt": head + rows[0] + "\n" + rows[7] + "\n"}
    assert whole(spark, clean, "TRN_002 TRN_016 XFL_014 XFL_016") == []


def test_stops_beside_stations(spark):
    stops = (
        "stop_id,stop_name,stop_lat,stop_lon,location_type,parent_station,stop_timezone\n"
        "A,Quay,47.500000,9.000000,1,,\nB,Quay East,47.500200,9.000000,1,,Europe/Zurich\nC,Far,47.600000,9.000000,1,,CET+1\n"
        "lone,Alone,47.500005,9.000000,,,\n"  # half a metre from A
        "own,Platform,47.500195,9.000000,0,A,\n"  # half a metre from B, of A
        "two,Platform,47.500201,9.000000,0,A,\n"  # the same pair again
        "good,Platform,47.500000,9.000001,0,A,\n"  # beside its own station
        "zero,Nowhere,0.000001,0.0,,,\nZ,Nowhere,0.0,0.0,1,,\n"
    )
    assert whole(spark, {"stops.txt": stops}, "STP_014 STP_046 STP_047") == [
        ("STP_014", "C", 4, "stop_timezone", "CET+1"),
        ("STP_046", "lone", None, "parent_station", "A"),
        ("STP_047", "A", None, "parent_station", "B"),
    ]


def test_transfers_of_trips_that_never_stop(spark):
    transfers = "from_stop_id,to_stop_id,transfer_type,from_trip_id,to_trip_id\n,,4,noon,still\n,,4,still,gone\n,,1,still,still\n,,5,noon,shore\n"
    files = {"transfers.txt": transfers, "trips.txt": BASE["trips.txt"] + "tram,weekend,still\n"}
    assert whole(spark, files, "TRF_014") == [("TRF_014", "still", 2, "from_trip_id", "still"), ("TRF_014", "still", 3, "from_trip_id", "still")]


def test_headsigns_on_the_way(spark):
    head = "trip_id,arrival_time,departure_time,stop_id,stop_sequence\n"
    call = lambda trip, stops: "".join(f"{trip},08:{10 + i}:00,08:{10 + i}:00,pier_{s},{i}\n" for i, s in enumerate(stops))
    times = head + call("noon", "nse") + call("night", "nsn") + call("shore", "nses") + call("short", "se")
    trips = "route_id,service_id,trip_id,trip_headsign\nferry,daily,noon,south pier\nferry,daily,night,South Pier\ntram,weekend,shore,South Pier\ntram,weekend,short,South Pier\n"
    # A circle, a stop that is passed twice, and the first stop don't count.
    assert whole(spark, {"stop_times.txt": times, "trips.txt": trips}, "TRP_020") == [("TRP_020", "noon", None, "trip_headsign", "pier_s")]


def test_routes_without_any_agency(spark):
    files = {"agency.txt": BASE["agency.txt"].splitlines()[0] + "\n", "routes.txt": "route_id,agency_id,route_long_name,route_type\nferry,,Crossing,4\ntram,lake,Shore Line,0\n"}
    assert whole(spark, files, "RTS_025") == [("RTS_025", "ferry", None, "agency_id", None)]
    assert whole(spark, {"routes.txt": files["routes.txt"]}, "RTS_025") == []

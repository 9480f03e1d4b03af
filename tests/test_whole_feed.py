"""The whole catalogue over a readable archive, and over a feed with every table of the catalogue."""

import zipfile
from datetime import date

import pytest
from test_feed import BASE

from timetide.plans import fused, views
from timetide.plans.catalogue import load
from timetide.plans.config import Config
from timetide.plans.engine import Run
from timetide.sources.feed import from_texts, read_zip

TODAY = date(2026, 5, 15)

#: rule, entity, file, line, field, seen.
CLEAN = """
ARC_006 calendar.txt calendar.txt - - -
ARC_011 agency.txt agency.txt - - 100 bytes
ARC_011 calendar.txt calendar.txt - - 166 bytes
ARC_011 routes.txt routes.txt - - 91 bytes
ARC_011 stop_times.txt stop_times.txt - - 289 bytes
ARC_011 stops.txt stops.txt - - 122 bytes
ARC_011 trips.txt trips.txt - - 82 bytes
ARC_020 - - - - feed_info.txt, shapes.txt
DQ_003 ferry routes.txt 2 route_desc -
DQ_003 tram routes.txt 3 route_desc -
DQ_004 ferry routes.txt 2 route_url -
DQ_004 tram routes.txt 3 route_url -
DQ_006 - trips.txt - shape_id 1.0
DQ_020 night trips.txt 3 trip_headsign -
DQ_020 noon trips.txt 2 trip_headsign -
DQ_020 shore trips.txt 4 trip_headsign -
GEO_013 - stops.txt - stop_lat 47.52 9.18 47.62 9.42
RTS_017 ferry trips.txt - shape_id -
RTS_017 tram trips.txt - shape_id -
STM_048 night stop_times.txt 6 arrival_time 6
STP_022 pier_e stops.txt 4 stop_code -
STP_022 pier_n stops.txt 2 stop_code -
STP_022 pier_s stops.txt 3 stop_code -
STP_033 pier_e stops.txt 4 zone_id -
STP_033 pier_n stops.txt 2 zone_id -
STP_033 pier_s stops.txt 3 zone_id -
STP_038 - stops.txt - wheelchair_boarding 3
TRP_011 night trips.txt 3 trip_headsign -
TRP_011 noon trips.txt 2 trip_headsign -
TRP_011 shore trips.txt 4 trip_headsign -
TRP_013 tram trips.txt - trip_id 1
TRP_021 - trips.txt - bikes_allowed 3
TRP_029 - trips.txt - wheelchair_accessible 3
"""


def test_whole_notices_of_an_archive(spark, tmp_path):
    path = tmp_path / "feed.zip"
    with zipfile.ZipFile(path, "w") as z:
        for name, text in BASE.items():
            z.writestr(name, text)
    feed = read_zip(spark, str(path))
    run = Run(feed, Config(today=TODAY))
    text = lambda v: "-" if v is None else str(v)
    got = sorted(" ".join(map(text, (r.rule_id, r.entity_id, r.file, r.line, r.field, r.observed_value))) for r in run.notices().collect())
    assert got == sorted(CLEAN.strip().splitlines())
    folder = spark._jvm.org.apache.hadoop.fs.Path(run.folder)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    kept = spark._jvm.org.apache.hadoop.fs.Path(feed.folder)
    assert files.exists(folder) and files.exists(kept)
    run.close()
    feed.close()
    assert not files.exists(folder) and not files.exists(kept)


def test_every_rule_runs_together(spark):
    """A feed with every table, each of one row of odd values beside the clean ones: no rule is passed over, and all come through."""
    files = dict(BASE)
    for table, columns in views.COLUMNS.items():
        files.setdefault(f"{table}.txt", ",".join(columns.split()) + "\n" + ",".join(f" {c[:3]}" for c in columns.split()) + "\n")
    run = Run(from_texts(spark, files), Config(today=TODAY))
    chosen = run.chosen()
    assert {r.rule_id for r in load()} - {r.rule_id for r in chosen} <= {"ARC_001", "ARC_029"} and len(chosen) > 540
    assert len(run.jobs(chosen)) < 150
    found = run.notices().collect()
    assert len({r.rule_id for r in found}) > 100
    assert {r.rule_id for r in found} <= {r.rule_id for r in chosen}
    run.close()


SQL = {
    "row": ("SELECT a AS id, b AS seen FROM near WHERE metres = 0", True),
    "whole": ("SELECT NULL AS id, count(*) AS seen FROM stops WHERE given(x) HAVING count(*) > max(y)", True),
    "group": ("SELECT min_by(r, line) AS id, count(*) AS seen, min(line) AS line FROM pts WHERE d > 1 GROUP BY lower(r) HAVING sum(d) > 3", True),
    "join": ("SELECT a AS id, b AS seen FROM x JOIN y ON c = d WHERE e", False),
    "inner": ("SELECT a AS id, b AS seen FROM x WHERE a IN (SELECT b FROM c)", False),
    "with": ("WITH c AS (SELECT 1) SELECT a AS id, b AS seen FROM c WHERE d", False),
    "alias": ("SELECT a AS id, b AS seen FROM x y WHERE d", False),
}


@pytest.mark.parametrize("name", SQL)
def test_forms(name):
    sql, fuses = SQL[name]
    form = fused.form_of(sql)
    assert (form is not None) == fuses
    if form:
        assert form.is_row == (name == "row")


def test_conditions_go_into_the_aggregates():
    assert fused.only_where("round(avg(a + max(b)), 1) / count(*)", "c > 0") == "round(avg(a + max(b)) FILTER (WHERE c > 0), 1) / count(*) FILTER (WHERE c > 0)"
    assert fused.only_where("min(a)", None) == "min(a)" and fused.only_where("a", "b") == "a"


def test_groups_and_whole_views_agree_with_plans_of_their_own(spark):
    """Rules of one form, each alone and all in one aggregate."""
    files = {"shapes.txt": "shape_id,shape_pt_lat,shape_pt_lon,shape_pt_sequence,shape_dist_traveled\n" + "".join(f"s{i % 5},{47 + i * i % 7 / 10},{9 + i % 3 / 10},{i},{i * 7 % 11}\n" for i in range(60))}
    run = Run(from_texts(spark, BASE | files), Config(today=TODAY, max_shape_points=5))
    rules = [r for r in run.chosen() if r.kind == "sql" and fused.form_of(r.plan[2]) is not None and r.table in ("shapes.txt", "trips.txt", "stops.txt")]
    assert len(rules) > 25
    columns = ["rule_id", "entity_type", "entity_id", "scope_key", "file", "line", "field", "observed_value", "instances"]
    together = run.raw_notices([r.rule_id for r in rules]).select(columns).collect()
    alone = [row for r in rules for row in run._alone(r).select(columns).collect()]
    assert sorted(map(str, together)) == sorted(map(str, alone)) and len(together) > 10
    run.close()

"""The archive itself: its entries, headers, rows and cells."""

import zipfile

import pytest
from test_feed import BASE, TODAY

from timetide.plans import notices as N
from timetide.plans.config import Config
from timetide.plans.engine import Run
from timetide.sources.feed import from_texts, read_zip

ARC = [f"ARC_{i:03d}" for i in range(1, 38) if i not in (5, 16, 20)] + ["DQ_016"]
QUIET = {"ARC_006", "ARC_011"}  # information on every feed


def found(run: Run) -> list:
    rows = run.notices(ARC).collect()
    return sorted((r.rule_id, r.file, r.line, r.field, r.observed_value) for r in rows if r.rule_id not in QUIET) if rows else []


def feed_of(spark, **files):
    return from_texts(spark, BASE | {f"{k}.txt": v for k, v in files.items()})


def test_clean(spark):
    assert found(Run(from_texts(spark, BASE), Config(today=TODAY))) == []


def key(x):
    return tuple("" if v is None else str(v) for v in x)


def test_headers_rows_and_cells(spark):
    stops = (
        "﻿stop_id, stop_name,stop_lat,stop_lon,stop_lat,,colour\n"
        "pier_n,North Pier ,47.62,9.18\n"
        "\n"
        "stop_id,stop_name,stop_lat,stop_lon,stop_lat,,colour\n"
        "piér_s,<b>South</b> Pier,47.52,9.31,,,,more\n"
        'pier_e,"East\nPier\x07",47.53,9.42,,,\n'
        'pier_w,West "old" Pier,47.5,9.1,,,\n'
    )
    run = Run(feed_of(spark, stops=stops, routes="route_id,route_long_name\nferry,a\rtram,b\n", levels="level_id,level_index\n"), Config(today=TODAY))
    rows = run.notices(ARC).collect()
    got = {(r.rule_id, r.file.removesuffix(".txt"), r.line, r.field, r.observed_value) for r in rows if r.rule_id not in QUIET}
    assert got == {
        ("ARC_010", "stops", None, None, "UTF-8 BOM (EF BB BF)"), ("ARC_014", "stops", 1, " stop_name", '" stop_name"'), ("ARC_015", "stops", 1, "stop_lat", "stop_lat"),
        ("ARC_017", "stops", 1, "colour", "colour"), ("ARC_017", "stops", 1, "", ""), ("ARC_019", "stops", 1, None, '""'), ("ARC_018", "stops", 3, None, None), ("ARC_034", "stops", 4, None, None),
        ("ARC_012", "stops", None, None, "1"), ("ARC_012", "stops", None, None, "2"), ("DQ_016", "stops", 2, "stop_name", "1"), ("ARC_032", "stops", 5, "stop_name", "1"), ("ARC_037", "stops", 5, "stop_id", "piér_s"),
        ("ARC_021", "stops", 6, None, "U+0007"), ("ARC_030", "stops", 6, None, "U+000A"), ("ARC_033", "stops", 7, None, "rows=1"),
        ("ARC_025", "routes", 1, "route_type", ""), ("ARC_026", "routes", None, None, "CR not followed by LF"), ("ARC_009", "levels", None, None, None),
    }
    assert run.views["stops"].count() == 4
    # Rows with more cells than the header are Critical; those that only leave out their last ones are information.
    assert {(r.severity, r.observed_value) for r in rows if r.rule_id == "ARC_012"} == {(None, "1"), ("Info", "2")}
    short = Run(feed_of(spark, stops="stop_id,stop_name,stop_lat,stop_lon,stop_code\npier_n,N,47.62,9.18\npier_s,S,47.52,9.31\npier_e,E,47.53,9.42,x\n"), Config(today=TODAY))
    notices = short.notices(ARC)
    assert [(r.severity, r.observed_value) for r in notices.filter("rule_id = 'ARC_012'").collect()] == [("Info", "2")]
    assert N.publishable(notices, short.rule_table()).first()["publishable"]


def test_files_and_encoding(spark):
    files = {k: v for k, v in BASE.items() if k not in ("agency.txt", "calendar.txt")} | {
        "translations.txt": b"table_name,field_name,language,translation\nstops,stop_name,de,M\xfcnchen\n",
        "routes.txt": "route_id,route_type\n", "lines.txt": "a\n1\n", "areas.txt": 'area_id,area_name\nx,"open\n', "levels.txt": "",
    }
    run = Run(from_texts(spark, files), Config(today=TODAY, source_url="https://lake.example/feed?x=.zip"))
    got = {(r.rule_id, r.file) for r in run.notices(ARC).collect() if r.rule_id not in QUIET}
    assert got == {
        ("ARC_004", "agency.txt"), ("ARC_008", None), ("ARC_031", None), ("ARC_002", "translations.txt"), ("ARC_003", "translations.txt"), ("ARC_035", "routes.txt"),
        ("ARC_007", "lines.txt"), ("ARC_013", "areas.txt"), ("ARC_009", "levels.txt"), ("ARC_028", None),
    }
    assert not N.publishable(run.notices(ARC), run.rule_table()).first()["publishable"]


@pytest.mark.parametrize("wrapped", [False, True])
def test_entries(spark, tmp_path, wrapped):
    path, inside = tmp_path / "feed.zip", "lake/" if wrapped else ""
    with zipfile.ZipFile(path, "w") as z:
        for name, text in BASE.items():
            z.writestr(inside + name, text)
        info = zipfile.ZipInfo(inside + "levels.txt")
        info.external_attr = 0o100200 << 16
        z.writestr(info, "level_id,level_index\nl,0\n")
        z.writestr(inside + "more.zip", b"x")
        z.writestr(inside + "readme.md", b"x")
    run = Run(read_zip(spark, str(path), keep=not wrapped), Config(today=TODAY))
    got = {(r.rule_id, r.file) for r in run.notices(ARC).collect() if r.rule_id not in QUIET}
    tables = {("ARC_024", inside + n) for n in [*BASE, "levels.txt"]} if wrapped else {("ARC_007", "readme.md")}
    assert got == {("ARC_027", inside + "levels.txt"), ("ARC_023", inside + "more.zip")} | tables


def test_unreadable_and_oversized(spark, tmp_path):
    bad = tmp_path / "bad.zip"
    bad.write_bytes(b"no archive")
    run = Run(read_zip(spark, str(bad)), Config(today=TODAY))
    assert [r.rule_id for r in run.notices().collect()] == ["ARC_001"]
    for name, text, fatal in (("bomb.zip", "\0" * (17 << 20), "ARC_029"), ("small.zip", "\0" * (15 << 20), None)):
        bomb = tmp_path / name
        with zipfile.ZipFile(bomb, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("shapes.dat", text)
        assert bomb.stat().st_size * 500 < len(text)
        feed = read_zip(spark, str(bomb))
        assert feed.fatal == fatal



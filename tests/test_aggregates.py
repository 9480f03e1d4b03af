"""Each summary's group, number and cleared columns, over findings made for it; a whole feed; scores."""

import pytest
from test_feed import BASE, TODAY

from timetide.plans import aggregates, archive
from timetide.plans import notices as N
from timetide.plans.catalogue import load
from timetide.plans.config import Config
from timetide.plans.engine import Run
from timetide.sources.feed import from_texts

SCHEMA = archive.SCHEMA + ", severity string, affected long"


@pytest.fixture(scope="module")
def collapsed(spark):
    """Of every contract three findings of one key and two of another, plus a rule without a summary."""
    rows = []
    for rule, (group, _, _) in aggregates.contracts().items():
        for i in range(5):
            one = "a" if i < 3 else "b"
            seen = "7" if group == "pair" and i in (0, 3) else one
            if group != "pair" or i in (0, 3):
                file = f"{one}.txt" if group == "file" else "x.txt"
                rows.append((rule, "thing", one if group != "feed" else f"e{i}", one, file, 10 + i, "f", seen, 1, None, None))
    rows += [("ARC_012", "file", "a.txt", None, "a.txt", None, None, "9", 1, "Info", 9), ("AGN_002", "agency", "q", "q", "agency.txt", 2, "agency_name", "v", 1, None, None)] * 2
    found = spark.createDataFrame(rows, SCHEMA)
    rules = spark.createDataFrame([(r.rule_id, r.severity, r.rule_class, r.dedup, r.base_effort, r.score_weight, list(r.blocks)) for r in load()], "rule_id string, severity string, rule_class string, dedup string, base_effort int, score_weight int, blocks array<string>")
    return aggregates.collapse(found, rules).collect()


@pytest.mark.parametrize("rule", sorted(aggregates.contracts()))
def test_contract(collapsed, rule):
    group, file, field = aggregates.contracts()[rule]
    got = sorted((r for r in collapsed if r.rule_id == rule and r.severity is None), key=lambda r: (r.entity_id or "", r.observed_value))
    count = {"feed": [5], "pair": [7, 7]}.get(group, [3, 2])
    assert [r.affected for r in got] == count
    assert [r.field for r in got] == [None if field == "-" else "f" if field == "=" else field] * len(got)
    for r in got:
        assert r.file == ("x.txt" if file == "=" and group != "file" else r.file if file == "=" else file)
        if group in ("feed", "value"):
            assert (r.entity_type, r.entity_id, r.scope_key, r.line) == ("feed", None, None, None)
        if group == "file":
            assert (r.entity_type, r.entity_id, r.scope_key, r.line) == ("file", r.file, None, None)
        if group == "entity":
            assert r.scope_key == r.entity_id and r.line is None
        assert r.observed_value == (str(r.affected) if group in ("feed", "file", "entity") else r.observed_value)
    if group == "value":
        assert sorted(r.observed_value for r in got) == ["a", "b"]


def test_apart_and_untouched(collapsed):
    assert [(r.severity, r.observed_value) for r in collapsed if r.rule_id == "ARC_012" and r.severity] == [("Info", "9")]
    assert [(r.entity_id, r.line, r.observed_value, r.affected) for r in collapsed if r.rule_id == "AGN_002"] == [("q", 2, "v", None)]


def test_duplicate_keys_and_order_of_a_feed(spark):
    stops = BASE["stops.txt"] + "pier_n,Again,47.7,9.2\npier_n,Third,47.8,9.2\npier_s,Other,47.9,9.3\n"
    times = BASE["stop_times.txt"] + "noon,13:00:00,13:00:00,pier_e,15\n"
    run = Run(from_texts(spark, BASE | {"stops.txt": stops, "stop_times.txt": times}), Config(today=TODAY))
    got = {(r.rule_id, r.file, r.field, r.observed_value, r.affected) for r in run.notices(["DQ_021", "STM_036", "ARC_020"]).collect()}
    assert got == {("DQ_021", "stops.txt", None, "2", 2), ("STM_036", "stop_times.txt", "trip_id", "1", 1), ("ARC_020", "-", None, "feed_info.txt, shapes.txt", None)}
    shown = {(r.rule_id, r.examples) for r in aggregates.examples(run.raw_notices(["DQ_021", "STM_036"])).collect()}
    assert shown == {("DQ_021", "pier_n, pier_s"), ("STM_036", "noon")}


def test_muted_and_overridden_rules_in_scores(spark):
    rules = Run(from_texts(spark, BASE), Config(today=TODAY)).rule_table()
    one = lambda rule, severity=None: (rule, "feed", None, None, None, None, None, None, 1, severity, None)
    table = lambda *rows: spark.createDataFrame(list(rows), SCHEMA)
    penalty = lambda *rows: {r.rule_id: r.penalty for r in N.penalties(table(*rows), rules).collect()}
    alone, muted = penalty(one("TRP_026")), penalty(one("TRP_026"), one("OPR_011"))
    assert alone["TRP_026"] > 0 and muted["TRP_026"] == 0 and muted["OPR_011"] > 0
    assert penalty(one("ARC_012", "Info")) == {"ARC_012": 0} and penalty(one("ARC_012", "Info"), one("ARC_012"))["ARC_012"] > 0
    assert not N.publishable(table(one("ARC_012")), rules).first()["publishable"]
    unread = ("ARC_002", "file", "stops.txt", None, "stops.txt", None, None, None, 1, None, None)
    assert not N.publishable(table(unread), rules).first()["publishable"]
    assert N.publishable(table(unread[:4] + ("levels.txt",) + unread[5:]), rules).first()["publishable"]

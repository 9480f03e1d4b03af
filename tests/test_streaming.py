"""Row checks over a stream of files."""

import pytest

from timetide.plans import views
from timetide.plans.config import Config
from timetide.plans.engine import Run
from timetide.sources.feed import from_texts
from timetide.streaming.live import counts, row_findings


def test_findings_and_windows(spark, tmp_path):
    rows = [("S1", "Stop 1", "41", "29", "2026-05-15 08:00:00"), ("S2", "", "99", "29", "2026-05-15 08:01:00"), ("S3", "STOP", "x", "29", "2026-05-15 08:07:00")]
    df = spark.createDataFrame(rows, "stop_id string, stop_name string, stop_lat string, stop_lon string, at string").selectExpr("* EXCEPT (at)", "CAST(at AS TIMESTAMP) AS at")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = counts(row_findings(stream, "stops"), "at").writeStream.outputMode("complete").format("memory").queryName("live").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["from"].minute, r["rule_id"]): r["n"] for r in spark.sql("SELECT * FROM live").collect()}
    assert got[(0, "STP_003")] == 1 and got[(5, "STP_004")] == 1 and got[(5, "DQ_018")] == 1


@pytest.mark.parametrize("table", ["routes", "stop_times", "calendar"])
def test_findings_as_in_a_run(spark, table):
    """Rows of a table have the findings that a run over a feed has of them."""
    columns = views.COLUMNS[table].split()
    text = "\n".join([",".join(columns), *[",".join(v for _ in columns) for v in ("x", "-1", "99999999", "25:00:00")]])
    run = Run(from_texts(spark, {f"{table}.txt": text}), Config())
    told = lambda found: sorted((r.rule_id, r.entity_id, r.field, r.observed_value) for r in found.collect())
    live = told(row_findings(run.views[table].select(*columns), table, Config()))
    assert live and live == told(run._row_rules(table, [r for r in run.rules.values() if r.kind == "row" and r.table == table], run.views[table]))

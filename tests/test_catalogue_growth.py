"""What the catalogue asks of a trip's order and of services grows with the tables, and doesn't hang on how rows come."""

from datetime import date

from pyspark.sql import functions as F

from timetide.plans.config import Config
from timetide.plans.engine import Run
from timetide.sources.feed import from_frames

TODAY = date(2026, 5, 15)


def _feed(spark, trips: int, reverse: bool = False):
    """Trips of one route and two services of 2,000 days; each calls twice, by one number and one line, ten minutes apart."""
    t = spark.range(trips).select((F.col("id") + 2).alias("line"), F.lit("r").alias("route_id"), F.concat(F.lit("s"), F.col("id") % 2).alias("service_id"), F.col("id").alias("trip_id"))
    calls = "SELECT {t}.line, trip_id, time AS arrival_time, time AS departure_time, stop_id, 1 AS stop_sequence FROM {t} CROSS JOIN VALUES ('08:00:00', 'a'), ('08:10:00', 'b') AS v(time, stop_id)"
    days = "SELECT id + 2 AS line, concat('s', id) AS service_id, 1 AS monday, 1 AS tuesday, 1 AS wednesday, 1 AS thursday, 1 AS friday, 0 AS saturday, 0 AS sunday, '20200101' AS start_date, '20270101' AS end_date FROM range(2)"
    frames = {
        "routes": spark.sql("SELECT 2 AS line, 'r' AS route_id, 3 AS route_type"),
        "trips": t,
        "stop_times": spark.sql(calls, t=t).coalesce(1).sortWithinPartitions(F.desc("arrival_time") if reverse else "arrival_time"),
        "calendar": spark.sql(days),
        "stops": spark.sql("SELECT id + 2 AS line, substring('ab', id + 1, 1) AS stop_id, 47.5 + id / 100 AS stop_lat, 9.2 AS stop_lon FROM range(2)"),
    }
    return from_frames(spark, frames, keep=True)


def test_routes_without_weekends_meet_services_not_trips(spark):
    run = Run(_feed(spark, 3000), Config(today=TODAY))
    found = run._alone(run.rules["OPR_004"])
    assert [(r.entity_id, r.observed_value) for r in found.collect()] == [("r", None)]
    # The rows that the largest step of the plan gives: 3,000 trips, not trips by days.
    largest, todo = 0, [found._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(node.plan())
        if node.metrics().contains("numOutputRows"):
            largest = max(largest, node.metrics().apply("numOutputRows").value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    assert 3000 <= largest <= 10_000
    run.close()
    run.feed.close()


def test_rows_of_one_number_and_line_have_an_order(spark):
    told = []
    for reverse in (False, True):
        run = Run(_feed(spark, 4, reverse), Config(today=TODAY))
        rows = run.notices(["STM_008", "STM_029", "STM_036", "STM_053", "OPR_007", "STM_032"]).collect()
        told.append(sorted((r.rule_id, r.entity_id) for r in rows))
        assert [(r.first_dep, r.last_arr, r.first_stop, r.last_stop, r.n) for r in run.views["spans"].collect()] == [(28800, 29400, "a", "b", 2)] * 4
        run.close()
        run.feed.close()
    assert told[0] == told[1]
    assert "STM_029" not in {r for r, _ in told[0]}  # ten minutes, not none

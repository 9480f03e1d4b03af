"""The catalogue over a timetable that is made of the star schema: orders are trips, their lines the stops that they call at.

Regions are agencies, nations routes, suppliers stops, order priorities services. A ninth of the orders have no route, and
whatever the tables lack (lines without an order, orders without lines) the checks find. The feed grows with the tables.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timetide.plans.config import Config
from timetide.plans.engine import Run
from timetide.sources.feed import Feed, from_frames

TODAY = date(1998, 8, 1)

#: `line` is a number of each row's own, as there is no file: from the keys of the row.
_TABLES = {
    "agency": "SELECT r_regionkey + 2 AS line, r_regionkey AS agency_id, r_name AS agency_name, concat('https://', lower(replace(r_name, ' ', '-')), '.example') AS agency_url, 'UTC' AS agency_timezone FROM region",
    "routes": "SELECT n_nationkey + 2 AS line, n_nationkey AS route_id, n_regionkey AS agency_id, n_name AS route_long_name, n_nationkey % 9 AS route_type FROM nation",
    "stops": "SELECT s_suppkey + 2 AS line, s_suppkey AS stop_id, s_name AS stop_name, round(30 + s_nationkey + s_suppkey % 997 * 0.0007, 6) AS stop_lat, round(5 + s_suppkey % 89 * 0.003, 6) AS stop_lon FROM supplier",
    "trips": "SELECT o_orderkey * 2 + 2 AS line, o_custkey % 28 AS route_id, o_orderpriority AS service_id, o_orderkey AS trip_id, o_orderstatus AS trip_headsign FROM orders",
    "stop_times": "SELECT l_orderkey * 64 + l_linenumber AS line, l_orderkey AS trip_id, t AS arrival_time, t AS departure_time, l_suppkey AS stop_id, l_linenumber AS stop_sequence FROM (SELECT *, format_string('%02d:%02d:00', 6 + m div 60, m % 60) AS t FROM (SELECT *, CAST(l_linenumber * 9 + l_partkey % 12 AS INT) AS m FROM lineitem))",
    "calendar": "SELECT ascii(o_orderpriority) AS line, o_orderpriority AS service_id, 1 AS monday, 1 AS tuesday, 1 AS wednesday, 1 AS thursday, 1 AS friday, 0 AS saturday, 0 AS sunday, date_format(min(o_orderdate), 'yyyyMMdd') AS start_date, date_format(max(o_orderdate), 'yyyyMMdd') AS end_date FROM orders GROUP BY o_orderpriority",
}


def feed_of(spark: SparkSession, folder: str) -> Feed:
    """The timetable of the tables in a folder."""
    made = {}
    for name, sql in _TABLES.items():
        used = [t for t in ("region", "nation", "supplier", "orders", "lineitem") if f"FROM {t}" in sql]
        made[name] = spark.sql(sql.replace(f"FROM {used[0]}", "FROM {star}"), star=spark.read.parquet(f"{folder}/{used[0]}.parquet"))
    return from_frames(spark, made, keep=True)


def whole_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """rule_id, severity, n: what every rule of the catalogue that applies reports, and how often."""
    run = Run(feed_of(spark, folder), Config(today=TODAY))
    found = run.notices().groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))
    return found.join(F.broadcast(run.rule_table().select("rule_id", F.col("severity"))), "rule_id").select("rule_id", "severity", "n")


def some_rules(spark: SparkSession, folder: str) -> DataFrame:
    """rule_id, entity_id, line, observed_value, instances of the notices of rules that SQL_RULES has too."""
    run = Run(feed_of(spark, folder), Config(today=TODAY))
    return run.notices(sorted(SQL_RULES)).select("rule_id", "entity_id", "line", "observed_value", "instances")


_SPANS = "SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1"
_TIMES = "SELECT l_orderkey AS k, l_orderkey * 64 + l_linenumber AS line, l_linenumber AS seq, 360 + l_linenumber * 9 + l_partkey % 12 AS m FROM lineitem"
#: By rule: its notices on the star schema, in DuckDB. id, line, seen, instances.
SQL_RULES = {
    "TRP_002": "SELECT o_orderkey, min(o_orderkey * 2 + 2), any_value(o_custkey % 28), 1 FROM orders WHERE o_custkey % 28 NOT IN (SELECT n_nationkey FROM nation) GROUP BY 1",
    "STM_001": "SELECT l_orderkey, min(l_orderkey * 64 + l_linenumber), l_orderkey, count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) GROUP BY 1",
    "STM_002": "SELECT l_suppkey, min(l_orderkey * 64 + l_linenumber), l_suppkey, count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier) GROUP BY 1",
    "XFL_002": "SELECT o_orderkey, min(o_orderkey * 2 + 2), o_orderkey, 1 FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) GROUP BY 1",
    "STP_020": "SELECT s_suppkey, min(s_suppkey + 2), s_suppkey, 1 FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem) GROUP BY 1",
    "STM_033": f"SELECT k, NULL, n, 1 FROM ({_SPANS}) WHERE n = 1",
    "OPR_006": f"SELECT k, NULL, n, 1 FROM ({_SPANS}) WHERE n < 2",
    "RTS_004": "SELECT n_nationkey, n_nationkey + 2, n_nationkey % 9, 1 FROM nation WHERE n_nationkey % 9 = 8",
    "RTS_017": "SELECT o_custkey % 28, NULL, NULL, 1 FROM orders GROUP BY 1",
    "TRP_013": "SELECT o_custkey % 28, NULL, 1, 1 FROM orders GROUP BY 1 HAVING count(*) = 1",
    "STP_022": "SELECT s_suppkey, min(s_suppkey + 2), NULL, 1 FROM supplier GROUP BY 1",
    "STM_045": f"SELECT k, NULL, max(m) * 60, 1 FROM ({_TIMES}) GROUP BY 1 HAVING max(m) * 60 > 26 * 3600",
    "DQ_006": "SELECT NULL, NULL, '1.0', 1",
    "TRP_021": "SELECT NULL, NULL, count(*), 1 FROM orders",
    "STM_044": "SELECT NULL, NULL, count(*), 1 FROM lineitem HAVING count(*) > 10000000",
}

QUERIES = {"q_feed_catalogue": whole_catalogue, "q_feed_rules": some_rules}
ORACLES = {"q_feed_rules": " UNION ALL ".join(f"SELECT '{rule}' AS rule_id, CAST(a AS VARCHAR) AS entity_id, CAST(b AS BIGINT) AS line, CAST(c AS VARCHAR) AS observed_value, CAST(d AS BIGINT) AS instances FROM ({sql}) x(a, b, c, d)" for rule, sql in SQL_RULES.items())}

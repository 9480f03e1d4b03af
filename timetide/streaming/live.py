"""Row checks over streams of table rows: findings as they come, and counts of them in event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timetide.functions.macros import expand
from timetide.plans import views
from timetide.plans.catalogue import load
from timetide.plans.config import Config
from timetide.plans.engine import row_case


def row_findings(rows: DataFrame, table: str, config: Config | None = None) -> DataFrame:
    """rule_id, entity_id, field, observed_value, and every column of rows not of the table (such as an event time).

    rows may be a stream: the checks are projections, so nothing is kept between batches.
    """
    config = config or Config()
    known = views.COLUMNS[table].split()
    own = rows.withColumns({c: F.lit(None).cast("string") for c in known if c not in rows.columns})
    facts: dict[str, str] = {}
    cases = [row_case(r, rows.columns, config, facts) for r in load() if r.kind == "row" and r.table == table]
    extra = [c for c in rows.columns if c not in known]
    asked = own.select("*", *[F.expr(expand(call)).alias(name) for call, name in facts.items()])
    found = asked.select(*extra, F.explode(F.expr(f"filter(array({', '.join(cases)}), x -> x IS NOT NULL)")).alias("n"))
    return found.select(*extra, "n.rule_id", "n.entity_id", "n.field", "n.observed_value")


def counts(findings: DataFrame, time: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """from, to, rule_id, n: findings by tumbling window; rows later than `late` behind the newest are dropped by the watermark."""
    by = findings.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), "rule_id").agg(F.count(F.lit(1)).alias("n"))
    return by.select(F.col("w.start").alias("from"), F.col("w.end").alias("to"), "rule_id", "n")

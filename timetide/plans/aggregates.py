"""Summaries: rules whose findings a feed reports as one notice a feed, file, entity or value, with their number.

The other rules keep one notice a key of their level. Both are one aggregate over all findings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timetide.plans import notices as N

# Rule, what its findings are grouped by, and the file and field of the summary (`=`: those of the findings, `-`: none).
CONTRACTS = """
STM_036 feed stop_times.txt trip_id
DQ_021 file = -
ARC_012 file = -
CLD_003 file = exception_type
SHP_005 feed shapes.txt shape_dist_traveled
STM_008 entity = =
STM_047 entity = =
PTH_007 entity = =
TRP_003 feed trips.txt service_id
TRN_001 feed translations.txt table_name
STP_004 feed stops.txt =
STP_005 feed stops.txt =
TRF_005 feed transfers.txt =
PTH_012 feed pathways.txt =
STP_042 feed stops.txt =
STP_032 feed stops.txt =
TRP_005 feed trips.txt =
STM_022 feed stop_times.txt =
STM_021 pair = =
STM_035 pair = =
FRQ_007 feed frequencies.txt exact_times
TRF_019 feed transfers.txt route_type
CAL_008 value calendar.txt end_date
GGL_001 feed transfers.txt transfer_type
FAR_010 feed fare_rules.txt fare_id
"""


def contracts() -> dict[str, tuple[str, str, str]]:
    return {r: (group, file, field) for r, group, file, field in (x.split() for x in CONTRACTS.strip().splitlines())}


def _by_rule(values: dict[str, str | None]):
    pairs = [x for k, v in values.items() for x in (F.lit(k), F.lit(v).cast("string"))]
    return F.create_map(*pairs)[F.col("rule_id")]


def _key(found: DataFrame, rules: DataFrame) -> tuple[DataFrame, object]:
    """The findings with `group` of their summary (null: none), and the key by which notices are one."""
    own = {r: g for r, (g, _, _) in contracts().items()}
    n = found.join(F.broadcast(rules.select("rule_id", "dedup")), "rule_id").withColumn("__group", _by_rule(own))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    # Rows of ARC_012 that are information have a summary of their own.
    apart = F.concat_ws("\x01", text("file"), text("severity"))
    key = F.when(F.col("__group") == "feed", F.lit("")).when(F.col("__group") == "file", apart).when(F.col("__group").isin("entity", "pair"), text("entity_id")).when(F.col("__group") == "value", text("observed_value")).otherwise(N._level_key(F.col("dedup")))
    return n, key


def collapse(found: DataFrame, rules: DataFrame) -> DataFrame:
    """Notices of a feed: one a summary with `affected`, else the first of each key of its rule's level (affected is null).

    Findings that already stand for several rows (`affected`, or `instances` of pairs) bring these along.
    """
    for c, kind in (("severity", "string"), ("affected", "long")):
        if c not in found.columns:
            found = found.withColumn(c, F.lit(None).cast(kind))
    n, key = _key(found, rules)
    first = N.first_of_each(n, key).withColumn("__group", _by_rule({r: g for r, (g, _, _) in contracts().items()}))
    files = _by_rule({r: f for r, (_, f, _) in contracts().items() if f != "="})
    fields = _by_rule({r: None if f == "-" else f for r, (_, _, f) in contracts().items() if f != "="})
    own_field = _by_rule({r: "1" for r, (_, _, f) in contracts().items() if f == "="}).isNotNull()
    g = F.col("__group")
    total = F.coalesce("affected", "merged")
    whole = F.coalesce(g.isin("feed", "value"), F.lit(False))
    keep = {
        "entity_type": F.when(whole, "feed").when(g == "file", "file").otherwise(F.col("entity_type")),
        "entity_id": F.when(whole, None).when(g == "file", F.col("file")).otherwise(F.col("entity_id")),
        "scope_key": F.when(whole | (g == "file"), None).when(g == "entity", F.col("entity_id")).otherwise(F.col("scope_key")),
        "file": F.coalesce(files, "file"),
        "line": F.when(whole | g.isin("file", "entity"), None).otherwise(F.col("line")),
        "field": F.when(g.isNull() | own_field, F.col("field")).otherwise(fields),
        "observed_value": F.when(g.isin("feed", "file", "entity"), total.cast("string")).otherwise(F.col("observed_value")),
        "affected": F.when(g == "pair", F.coalesce(F.col("observed_value").cast("long"), total)).when(g.isNotNull(), total).otherwise(F.col("affected")),
    }
    return first.select(*[keep.get(c, F.col(c)).alias(c) for c in [*N.COLUMNS, *N.EXTRA]])


def examples(found: DataFrame, most: int = 5) -> DataFrame:
    """rule_id, file, examples: the least distinct ids (for files: lines) of the findings of each rule that has a summary."""
    n = found.filter(F.col("rule_id").isin(*contracts())).select("rule_id", "file", F.coalesce("entity_id", F.col("line").cast("string")).alias("id")).filter("id IS NOT NULL").distinct()
    w = Window.partitionBy("rule_id", "file").orderBy("id")
    few = n.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= most)
    return few.groupBy("rule_id", "file").agg(F.array_join(F.array_sort(F.collect_list("id")), ", ").alias("examples"))

"""Findings ("notices") and what is made of them: order, de-duplication, caps, root causes, scores, fix queue.

A notices table has rule_id, entity_type, entity_id, scope_key, file, line, field, observed_value and `instances`; a rules
table has rule_id, severity, rule_class, dedup, base_effort, score_weight and blocks (array of rule ids). Notices of a feed also
have `severity` (null, or another one than the rule's) and `affected` (how many findings a summary stands for).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timetide.operators.lineage import cut

EXTRA = ["severity", "affected"]
COLUMNS = ["rule_id", "entity_type", "entity_id", "scope_key", "file", "line", "field", "observed_value", "instances"]

# Severity weights, class weights of the overall score, the constant of the decay.
SEVERITY_WEIGHTS = {"Critical": 4, "High": 3, "Medium": 2, "Low": 1, "Info": 0}
CLASS_WEIGHTS = {"Spec": 0.4, "Interop": 0.3, "Quality": 0.2, "Analytics": 0.1}
DECAY = 50
# Rules that don't count in scores where another one has notices.
MUTED = {"TRP_026": "OPR_011", "OPR_006": "STM_033"}
# Findings after which a feed isn't wholly read, where they are about one of these files or the archive.
UNREAD = ("ARC_001", "ARC_002", "ARC_013", "ARC_029")
NEEDED_FILES = ("agency.txt", "stops.txt", "routes.txt", "trips.txt", "stop_times.txt", "calendar.txt", "calendar_dates.txt")


def notices(df: DataFrame, rule_id: str, file: str, entity_type: str, entity_id: str, scope_key: str | None = None, line: str | None = None, field: str | None = None, observed: str | None = None, instances: str = "1", file_column: str | None = None) -> DataFrame:
    """One notice for each row of df; arguments from entity_id on, but for field, are columns or SQL expressions."""
    text = lambda x: F.expr(x).cast("string") if x else F.lit(None).cast("string")
    number = F.expr(line).cast("long") if line else F.lit(None).cast("long")
    return df.select(
        F.lit(rule_id).alias("rule_id"), F.lit(entity_type).alias("entity_type"), text(entity_id).alias("entity_id"), text(scope_key).alias("scope_key"), (F.col(file_column) if file_column else F.lit(file)).alias("file"),
        number.alias("line"), F.lit(field).cast("string").alias("field"), text(observed).alias("observed_value"), F.expr(instances).cast("long").alias("instances"),
    )


def total_order() -> list[Column]:
    """Rule, entity type, entity id, line, file, field, scope; missing texts count as empty, missing lines as 0."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return [F.col("rule_id"), text("entity_type"), text("entity_id"), F.coalesce(F.col("line"), F.lit(0)), text("file"), text("field"), text("scope_key")]


def _level_key(level: Column) -> Column:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    row = F.coalesce(F.col("line").cast("string"), F.concat_ws("\x01", F.lit(""), text("entity_id"), text("observed_value")))
    return (
        F.when(level == "Feed", F.lit(""))
        .when(level == "File", text("file"))
        .when(level == "Entity", F.concat_ws("\x01", text("entity_type"), text("entity_id")))
        .when(level == "Row", F.concat_ws("\x01", text("file"), row))
        .otherwise(F.concat_ws("\x01", text("file"), row, text("field")))
    )


def first_of_each(found: DataFrame, key: Column) -> DataFrame:
    """The first notice, in total order, of each rule and key, and `merged`, their number.

    One aggregate: a hot key leaves each task as one row.
    """
    extra = [c for c in EXTRA if c in found.columns]
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    weight = [F.coalesce(F.col("severity"), F.lit(""))] if "severity" in extra else []  # a rule's own severity comes first
    order = [c.alias(f"o{i}") for i, c in enumerate([*total_order()[1:], *weight, text("observed_value")])]
    rest = [c for c in COLUMNS if c != "rule_id"] + extra
    n = found.select("rule_id", key.alias("__key"), F.struct(*order, *rest).alias("__row"))
    return n.groupBy("rule_id", "__key").agg(F.min("__row").alias("__row"), F.count(F.lit(1)).alias("merged")).select("rule_id", *[F.col(f"__row.{c}") for c in rest], "merged")


def deduplicate(found: DataFrame, rules: DataFrame) -> DataFrame:
    """The first notice, in total order, of each key of its rule's level (Feed, File, Entity, Row, Field).

    Where the row isn't known (no line), the entity and the value stand for it.
    """
    n = found.join(F.broadcast(rules.select("rule_id", "dedup")), "rule_id")  # one row a rule of the catalogue
    return first_of_each(n, _level_key(F.col("dedup"))).drop("merged")


def cap(found: DataFrame, most: int) -> DataFrame:
    """The first notices of each rule in total order, with `nth` and the rule's true total."""
    totals = found.groupBy("rule_id").agg(F.count(F.lit(1)).alias("total"))
    w = Window.partitionBy("rule_id").orderBy(*total_order(), F.coalesce("observed_value", F.lit("")))
    kept = found.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= most)
    return kept.join(F.broadcast(totals), "rule_id")


def summaries(found: DataFrame, examples: int = 3) -> DataFrame:
    """rule_id, file, affected, first_line, examples: notices of a rule and file as one row."""
    first = found.groupBy("rule_id", "file").agg(F.count(F.lit(1)).alias("affected"), F.min("line").alias("first_line"))
    # Examples are the least distinct ids: the rank limit keeps a task from gathering a group.
    ids = found.select("rule_id", "file", "entity_id").filter("entity_id IS NOT NULL").distinct()
    w = Window.partitionBy("rule_id", "file").orderBy("entity_id")
    few = ids.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= examples)
    listed = few.groupBy("rule_id", "file").agg(F.array_join(F.array_sort(F.collect_list("entity_id")), ",").alias("examples"))
    return first.join(listed, ["rule_id", "file"], "left")


def _pairs(found: DataFrame, rules: DataFrame) -> DataFrame:
    """rule_id, scope_key (empty for the whole feed), blocks of the notices, once each."""
    return found.select("rule_id", F.coalesce("scope_key", F.lit("")).alias("scope")).distinct().join(F.broadcast(rules.select("rule_id", "blocks")), "rule_id")


def caused(found: DataFrame, rules: DataFrame) -> DataFrame:
    """root_rule, root_scope, rule_id, scope: which (rule, scope) with notices a root blocks directly.

    A root without scope blocks every scope, one with a scope the same scope only.
    """
    pairs = _pairs(found, rules)
    roots = pairs.select(F.col("rule_id").alias("root_rule"), F.col("scope").alias("root_scope"), F.explode("blocks").alias("rule_id"))
    hit = pairs.select("rule_id", "scope")
    # Two joins: the few roots without scope (one a pair of rules) by rule, all others by rule and scope.
    whole = hit.join(F.broadcast(roots.filter("root_scope = ''")), "rule_id")
    same = hit.join(roots.filter("root_scope <> ''").withColumn("scope", F.col("root_scope")), ["rule_id", "scope"])
    columns = ["root_rule", "root_scope", "rule_id", "scope"]
    return whole.select(columns).unionByName(same.select(columns))


def symptoms(found: DataFrame, rules: DataFrame) -> DataFrame:
    """The notices that another one causes."""
    hit = caused(found, rules).select("rule_id", F.col("scope").alias("__scope")).distinct()
    return found.join(hit, (found["rule_id"] == hit["rule_id"]) & (F.coalesce(found["scope_key"], F.lit("")) == hit["__scope"]), "left_semi")


def closure(found: DataFrame, rules: DataFrame) -> DataFrame:
    """root_rule, root_scope, rule_id, scope: everything that a root causes directly or through others, itself left out."""
    step = cut(caused(found, rules))
    reached = frontier = step
    link = step.select(F.col("root_rule").alias("mid_rule"), F.col("root_scope").alias("mid_scope"), F.col("rule_id").alias("to_rule"), F.col("scope").alias("to_scope"))
    while True:
        further = frontier.join(link, (F.col("rule_id") == F.col("mid_rule")) & (F.col("scope") == F.col("mid_scope"))).select("root_rule", "root_scope", F.col("to_rule").alias("rule_id"), F.col("to_scope").alias("scope")).distinct()
        frontier = cut(further.join(reached, ["root_rule", "root_scope", "rule_id", "scope"], "left_anti"))
        if frontier.isEmpty():
            return reached.filter("NOT (root_rule = rule_id AND root_scope = scope)")
        reached = cut(reached.unionByName(frontier))


def multiplier(instances: Column) -> Column:
    return F.when(instances <= 5, 1.0).when(instances <= 50, 1.5).otherwise(2.0)


def _severity_weight() -> Column:
    weight = F.lit(0)
    for name, w in SEVERITY_WEIGHTS.items():
        weight = F.when(F.col("severity") == name, w).otherwise(weight)
    return weight


def _severities(found: DataFrame) -> list[Column]:
    """An aggregate for the severity of a rule: its own, unless all its notices have another one."""
    return [F.when(F.count_if(F.col("severity").isNull()) == 0, F.min("severity")).alias("__other")] if "severity" in found.columns else []


def with_rules(per_rule: DataFrame, rules: DataFrame) -> DataFrame:
    """Figures by rule with the rule's columns; `severity` is that of its notices where they have one."""
    out = per_rule.join(F.broadcast(rules), "rule_id")
    return out.withColumn("severity", F.coalesce("__other", "severity")).drop("__other") if "__other" in per_rule.columns else out


def penalties(found: DataFrame, rules: DataFrame) -> DataFrame:
    """rule_id, severity, rule_class, instances, penalty of every rule with notices."""
    per_rule = with_rules(found.groupBy("rule_id").agg(F.sum("instances").alias("instances"), *_severities(found)), rules)
    # One row a rule: all of them fit one task.
    has = lambda rule: F.max(F.col("rule_id") == rule).over(Window.partitionBy(F.lit(0)))
    weight = F.col("score_weight")
    for rule, other in MUTED.items():
        weight = F.when((F.col("rule_id") == rule) & has(other), 0).otherwise(weight)
    return per_rule.withColumn("penalty", _severity_weight() * weight * multiplier(F.col("instances")))


def scores(found: DataFrame, rules: DataFrame) -> DataFrame:
    """name, score: of each class, overall and for publishing (Spec and Critical only), one decimal."""
    p = penalties(found, rules)
    decayed = lambda flag: F.lit(100.0 * DECAY) / (DECAY + F.coalesce(F.sum(F.when(flag, F.col("penalty"))), F.lit(0.0)))
    row = p.agg(*[decayed(F.col("rule_class") == c).alias(c) for c in CLASS_WEIGHTS], decayed((F.col("rule_class") == "Spec") & (F.col("severity") == "Critical")).alias("publish"))
    overall = sum((w * F.col(c) for c, w in CLASS_WEIGHTS.items()), F.lit(0.0))
    row = row.withColumn("overall", overall)
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.round(F.col(c), 1).alias("score")) for c in [*CLASS_WEIGHTS, "overall", "publish"]])).alias("s")).select("s.*")


def fix_queue(found: DataFrame, rules: DataFrame) -> DataFrame:
    """rule_id, affected, dependents, fix_effort, priority of every rule with notices that nothing else causes."""
    hit = caused(found, rules)
    dependents = hit.select(F.col("root_rule").alias("rule_id"), F.col("rule_id").alias("blocked")).distinct().groupBy("rule_id").agg(F.count(F.lit(1)).alias("dependents"))
    causes = hit.select(F.col("rule_id").alias("__r"), F.col("scope").alias("__s")).distinct()
    roots = found.join(causes, (found["rule_id"] == causes["__r"]) & (F.coalesce(found["scope_key"], F.lit("")) == causes["__s"]), "left_anti")
    q = with_rules(roots.groupBy("rule_id").agg(F.sum("instances").alias("affected"), *_severities(found)), rules).join(dependents, "rule_id", "left")
    q = q.withColumn("dependents", F.coalesce("dependents", F.lit(0))).withColumn("fix_effort", F.col("base_effort") * multiplier(F.col("affected")))
    priority = _severity_weight() * (1 + F.col("dependents")) * F.log2(1 + F.col("affected")) / F.col("fix_effort")
    return q.select("rule_id", "severity", "affected", "dependents", "fix_effort", F.round(priority, 2).alias("priority"))


def score_deltas(found: DataFrame, rules: DataFrame) -> DataFrame:
    """rule_id, score_delta, publish_delta of every rule of the fix queue: by how much the overall score and that for publishing
    would rise without its notices that nothing else causes and without all that these cause.

    Instances are counted by rule and scope once, so the new sums are the old ones less what a root takes from each rule:
    a row a pair of rules. A rule that keeps some instances keeps their penalty. For publishing, the penalty of the
    instances that go is taken off.
    """
    each = found.groupBy("rule_id", F.coalesce("scope_key", F.lit("")).alias("scope")).agg(F.sum("instances").alias("n"))
    effects = caused(found, rules).select("rule_id", "scope").distinct()
    roots = each.join(effects, ["rule_id", "scope"], "left_anti").select(F.col("rule_id").alias("root_rule"), F.col("scope").alias("root_scope"))
    own = roots.select("root_rule", F.col("root_rule").alias("rule_id"), F.col("root_scope").alias("scope"))
    further = closure(found, rules).join(roots, ["root_rule", "root_scope"], "left_semi").select("root_rule", "rule_id", "scope")
    taken = own.unionByName(further).distinct().join(each, ["rule_id", "scope"]).groupBy("root_rule", "rule_id").agg(F.sum("n").alias("taken"))
    p = penalties(found, rules).select("rule_id", "rule_class", "severity", "instances", "penalty", (F.col("penalty") / multiplier(F.col("instances"))).alias("weight"))
    for_publishing = (F.col("rule_class") == "Spec") & (F.col("severity") == "Critical")
    sums = p.agg(*[F.coalesce(F.sum(F.when(flag, F.col("penalty"))), F.lit(0.0)).alias(c) for c, flag in [*((c, F.col("rule_class") == c) for c in CLASS_WEIGHTS), ("publish", for_publishing)]]).first()
    left = F.when(F.col("instances") > F.col("taken"), F.col("weight") * multiplier(F.col("instances") - F.col("taken"))).otherwise(0.0)
    less = taken.join(F.broadcast(p), "rule_id").withColumns({"less": F.col("penalty") - left, "gone": F.col("weight") * multiplier(F.col("taken"))})  # one row a rule
    by_class = [F.coalesce(F.sum(F.when(F.col("rule_class") == c, F.col("less"))), F.lit(0.0)).alias(c) for c in CLASS_WEIGHTS]
    told = less.groupBy(F.col("root_rule").alias("rule_id")).agg(*by_class, F.coalesce(F.sum(F.when(for_publishing, F.col("gone"))), F.lit(0.0)).alias("publish"))
    score = lambda x: F.lit(100.0 * DECAY) / (DECAY + x)
    rise = sum((w * (score(F.lit(sums[c]) - F.col(c)) - score(F.lit(sums[c]))) for c, w in CLASS_WEIGHTS.items()), F.lit(0.0))
    publish = score(F.greatest(F.lit(sums["publish"]) - F.col("publish"), F.lit(0.0))) - score(F.lit(sums["publish"]))
    return told.select("rule_id", F.round(rise, 1).alias("score_delta"), F.round(publish, 1).alias("publish_delta"))


def publishable(found: DataFrame, rules: DataFrame) -> DataFrame:
    """One row: publishable, blocking (rules of class Spec and severity Critical that have notices).

    A feed of which a needed file or the archive could not be read is not publishable either.
    """
    per_rule = found.groupBy("rule_id").agg(*_severities(found), F.max(F.col("file").isNull() | F.col("file").isin(*NEEDED_FILES)).alias("__needed"))
    bad = with_rules(per_rule, rules).select(((F.col("rule_class") == "Spec") & (F.col("severity") == "Critical")).alias("bad"), (F.col("rule_id").isin(*UNREAD) & F.col("__needed")).alias("unread"))
    return bad.agg((F.count_if(F.col("bad") | F.col("unread")) == 0).alias("publishable"), F.count_if("bad").alias("blocking"))


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """rule_id, n_before, n_after, change: Fixed, Decreased, Increased, New or Same."""
    a = before.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n_before"))
    b = after.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n_after"))
    j = a.join(b, "rule_id", "full").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_before", "n_after")})
    change = F.when(F.col("n_after") == 0, "Fixed").when(F.col("n_before") == 0, "New").when(F.col("n_after") < F.col("n_before"), "Decreased").when(F.col("n_after") > F.col("n_before"), "Increased").otherwise("Same")
    return j.withColumn("change", change)

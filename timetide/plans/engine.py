"""Running the catalogue over a feed: which rules apply, and as few plans as answer them.

Typed views are made when a rule asks for them, once a run, and kept as Parquet in the checkpoint folder, as are the
findings: a whole catalogue in one plan would not be planned in useful time. Rules of one form over one view are one plan
(timetide.plans.fused), those about keys are one, the others a plan each, a few of them in one job. Jobs run side by side.
"""

from __future__ import annotations

import re
import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from threading import RLock

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timetide.functions.macros import expand, shared
from timetide.operators import lineage
from timetide.plans import aggregates, archive, fused, views
from timetide.plans import notices as N
from timetide.plans.catalogue import GROUPED, ROWS, Rule, load
from timetide.plans.config import Config
from timetide.sources.feed import Feed

VIEW = "tt_"
_NAMES = {*views.COLUMNS, *views.TYPED, "near", "walked", "joined", "unmatched", "recorded", "stations_near"}
_FROM = re.compile(r"\b(FROM|JOIN)\s+(" + "|".join(sorted(_NAMES, key=len, reverse=True)) + r")\b")


def literal(sql: str, config: Config) -> str:
    """sql with the names of thresholds replaced by their values."""
    for name, value in config.literals().items():
        sql = re.sub(rf"\b{name}\b(?!\()", lambda _, v=value: v, sql)
    return sql


def row_case(r: Rule, header: list[str], config: Config, facts: dict[str, str]) -> str:
    """A row rule as a CASE expression: a finding, or null. What it asks of single cells goes into facts (macro call, column), for all rules once."""
    kind, key, field, predicate = r.plan
    predicate = re.sub(r"\bhas\((\w+)\)", lambda m: "true" if m[1] in header else "false", predicate)
    predicate = shared(literal(predicate, config), facts)
    feed_level = str(r.dedup in ("Feed", "File")).lower()
    return f"CASE WHEN {predicate} THEN named_struct('rule_id', '{r.rule_id}', 'entity_type', '{kind}', 'entity_id', `{key}`, 'field', '{field}', 'observed_value', `{field}`, 'feed_level', {feed_level}) END"


#: Plans of their own in one job, and jobs that run side by side.
PLANS_A_JOB, JOBS = 6, 12


class _Views(dict):
    """The views of a run by name; typed ones are made when they are asked for."""

    def __init__(self, texts: dict[str, DataFrame], make):
        super().__init__(texts)
        self._make = make

    def __missing__(self, name: str) -> DataFrame:
        self._make(name)
        return self[name]


class Run:
    """One feed under one configuration. Rules without their tables are passed over. `close()` removes what the run has written."""

    def __init__(self, feed: Feed, config: Config | None = None):
        self.feed, self.config = feed, config or Config()
        self.rules = {r.rule_id: r for r in load()}
        if bad := sorted(x for x in self.config.disabled_rule_ids if x not in self.rules or self.rules[x].rule_class == "Spec"):
            raise ValueError(f"rules that can't be disabled: {bad}")
        self.skipped: list[str] = []
        self.id = uuid.uuid4().hex
        self._lock = RLock()
        self.views = _Views(views.text_views(feed, str(self.config.today)), self._make)
        for name, df in self.views.items():
            df.createOrReplaceTempView(self._name(name))

    def _name(self, view: str) -> str:
        return f"{VIEW}{self.id}_{view}"

    @property
    def folder(self) -> str:
        lineage.ready(self.feed.spark)
        return f"{self.feed.spark.sparkContext.getCheckpointDir()}/run-{self.id}"

    def close(self) -> None:
        """Remove the views and files of this run; its notices can't be read after that."""
        for name in self.views:
            self.feed.spark.catalog.dropTempView(self._name(name))
        lineage.remove(self.feed.spark, self.folder)

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        """df, written once and read again."""
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.feed.spark.read.schema(df.schema).parquet(path)

    def _make(self, name: str) -> None:
        with self._lock:
            if name in self.views:
                return
            if name == "near":
                df = views.near(self.views["places"], self.config.stop_too_close_m)
            elif name == "walked":
                df = views.walked(self.views["pathways"], self.views["places"])
            elif name == "joined":
                df = views.joined(self.views["legs"])
            elif name == "unmatched":
                df = views.unmatched(self.feed, self.views.__getitem__)
            elif name == "recorded":
                df = views.recorded(self.views.__getitem__)
            elif name == "stations_near":
                df = views.stations_near(self.views["places"])
            else:
                df = self._query(views.typed(views.TYPED[name]))
            df = self._kept(df, name)
            if df.isEmpty():
                df = df.filter(F.lit(False))  # so that the optimizer knows
            df.createOrReplaceTempView(self._name(name))
            self.views[name] = df

    def _query(self, sql: str) -> DataFrame:
        return self.feed.spark.sql(self._named(literal(sql, self.config)))

    def _named(self, sql: str) -> str:
        """Names of views as those of this run, unless a WITH clause of the query has that name. Views are made if need be."""
        own = set(re.findall(r"(?:WITH|,)\s+(\w+) AS \(", sql))

        def one(m: re.Match) -> str:
            if m[2] in own:
                return m[0]
            self.views[m[2]]
            named = re.match(r"\s+(?:AS\s+)?(?!ON\b|JOIN\b|WHERE\b|GROUP\b|LEFT\b|HAVING\b|WINDOW\b|UNION\b|USING\b|CROSS\b|ORDER\b)\w+", sql[m.end() :])
            return f"{m[1]} {self._name(m[2])}" + ("" if named else f" AS {m[2]}")

        return _FROM.sub(one, sql)

    def _row_findings(self, table: str, rules: list[Rule]) -> DataFrame:
        """All row rules of a table, in a pass over its rows; findings that are there only because of blanks around cells are marked.

        The rows with such cells, few as a rule, are written without the blanks and judged again.
        """
        found = self._row_rules(table, rules, self.views[table])
        rows = self._kept(fused.trimmed(self.views[table]), "trimmed")
        if rows.isEmpty():
            return found
        again = self._row_rules(table, rules, rows)
        return fused.split_derived(found, rows.select(F.lit(f"{table}.txt").alias("file"), "line"), again)

    def _row_rules(self, table: str, rules: list[Rule], rows: DataFrame) -> DataFrame:
        """The findings of rows of a table: an array a row, without nulls, exploded."""
        header = self.feed.headers.get(table, [])
        facts: dict[str, str] = {}
        cases = [row_case(r, header, self.config, facts) for r in rules]
        asked = rows.select("*", *[F.expr(expand(call)).alias(name) for call, name in facts.items()])
        found = asked.select("line", F.explode(F.expr(f"filter(array({', '.join(cases)}), x -> x IS NOT NULL)")).alias("n")).select("line", "n.*")
        scope = F.when(~F.col("feed_level"), F.col("entity_id"))
        return found.select("rule_id", "entity_type", "entity_id", scope.alias("scope_key"), F.lit(f"{table}.txt").alias("file"), "line", "field", "observed_value", F.lit(1).cast("long").alias("instances"))

    def _keyed(self, r: Rule) -> fused.Keyed:
        """A rule about keys: rows whose key is missing (GROUPED rules: each missing key once), parents that are unused, repeated keys."""
        if r.kind == "duplicate":
            return fused.Keyed(r, r.table, r.plan, r.table, r.plan[0], None)
        key, among = r.plan
        if r.kind == "unused":
            return fused.Keyed(r, r.table, (key,), r.table, key, among)
        if r.rule_id in GROUPED:
            return fused.Keyed(r, r.table, (key,), "stop" if key == "stop_id" else ROWS[r.table][0].split()[0], key, among, True)
        kind, entity = ROWS[r.table][0].split() if r.table in ROWS else (r.table, key)
        return fused.Keyed(r, r.table, (key,), kind, entity, among)

    def _alone(self, r: Rule) -> DataFrame:
        """A rule with a plan of its own."""
        _, field, sql = r.plan
        sql = views.typed(sql)
        scope = "id" if r.dedup not in ("Feed", "File") else None
        found = self._query(sql)
        # A query that knows the row says so by `line`, or shows it as what was seen.
        line = "line" if "line" in found.columns else "seen" if re.match(r"SELECT .*?\bline AS seen\b", sql) else None
        out = N.notices(found, r.rule_id, r.table, r.table.removesuffix(".txt"), "id", scope, line, None if field == "-" else field, "seen")
        return out if r.table != "*" else N.notices(found, r.rule_id, "", "file", "id", scope, line, None, "seen", file_column="file")

    def chosen(self, only: list[str] | None = None) -> list[Rule]:
        """The rules that run: asked for, not disabled, with the tables that they need."""
        self.skipped, out = [], []
        for r in self.rules.values():
            if (only is not None and r.rule_id not in only) or r.rule_id in self.config.disabled_rule_ids:
                continue
            if self.feed.fatal and r.rule_id != self.feed.fatal:
                self.skipped.append(r.rule_id)
                continue
            tables = [t for t in r.needs if t in views.COLUMNS]
            optional = r.kind == "unused" and not all(t in self.feed.tables for t, _ in r.plan[1][:1])
            if all(t in self.feed.tables for t in tables) and not optional:
                out.append(r)
            else:
                self.skipped.append(r.rule_id)
        return out

    def jobs(self, rules: list[Rule]) -> list:
        """Functions that give the findings of some of the rules each, as few plans as can be."""
        out, forms, alone = [], {}, []
        for table in ROWS:
            if own := [r for r in rules if r.kind == "row" and r.table == table]:
                out.append(lambda table=table, own=own: [self._row_findings(table, own)])
        for r in (r for r in rules if r.kind == "sql"):
            form = None if r.table == "*" else fused.form_of(r.plan[2])
            if form is None:
                alone.append(r)
            else:
                forms.setdefault((form.view, "row" if form.is_row else form.keys), []).append((r, form))
        for own in forms.values():
            out.append(lambda own=own: [self._query(views.typed(fused.fused_sql(own)))])
        if keyed := [self._keyed(r) for r in rules if r.kind in ("fk", "unused", "duplicate")]:
            out.append(lambda: fused.key_findings(self.views.__getitem__, keyed, lambda df: self._kept(df, "keys")))
        for at in range(0, len(alone), PLANS_A_JOB):
            out.append(lambda own=alone[at : at + PLANS_A_JOB]: [self._alone(r) for r in own])
        if own := {r.rule_id for r in rules if r.kind == "archive"}:
            out += archive.jobs(self.feed, self.config, own)
        return out

    def raw_notices(self, only: list[str] | None = None) -> DataFrame:
        """Every finding of the rules that run, before de-duplication: computed here, and read from the run's folder.

        derived: true where only blanks around a cell make the finding.
        """
        schema = ", ".join(f"{k} {v}" for k, v in fused.FOUND.items())
        folder = f"{self.folder}/found-{uuid.uuid4().hex}"

        def work(job: tuple) -> str | None:
            number, parts = job
            if not (parts := [p.select(*[(F.col(c) if c in p.columns else F.lit(None)).cast(kind).alias(c) for c, kind in fused.FOUND.items()]) for p in parts()]):
                return None
            reduce(DataFrame.unionByName, parts).write.parquet(f"{folder}/{number}")
            return f"{folder}/{number}"

        with ThreadPoolExecutor(JOBS) as pool:
            paths = [p for p in pool.map(work, enumerate(self.jobs(self.chosen(only)))) if p]
        if not paths:
            return self.feed.spark.createDataFrame([], schema)
        return self.feed.spark.read.schema(schema).parquet(*paths)

    def rule_table(self) -> DataFrame:
        rows = [(r.rule_id, r.severity, r.rule_class, r.dedup, r.base_effort, r.score_weight, list(r.blocks)) for r in self.rules.values()]
        return self.feed.spark.createDataFrame(rows, "rule_id string, severity string, rule_class string, dedup string, base_effort int, score_weight int, blocks array<string>")

    def notices(self, only: list[str] | None = None) -> DataFrame:
        """Notices as a feed reports them: summaries, and the first of each key of the other rules.

        Findings that blanks around cells make are left out where their file has DQ_016, which tells of such cells; that notice
        says how many they are and of which rules (`suppressed`, `suppressed_rules`).
        """
        raw = self.raw_notices(only)
        roots = raw.filter("rule_id = 'DQ_016'").select("file").distinct().withColumn("root", F.lit(True))  # a row a file
        told = raw.join(F.broadcast(roots), "file", "left").withColumn("hidden", F.coalesce(F.col("derived") & F.col("root"), F.lit(False)))
        hidden = told.filter("hidden").groupBy("file").agg(F.count(F.lit(1)).alias("suppressed"), F.array_join(F.array_sort(F.collect_set("rule_id")), ", ").alias("suppressed_rules"))
        shown = aggregates.collapse(told.filter("NOT hidden").drop("root", "hidden", "derived"), self.rule_table())
        declared = hidden.withColumn("rule_id", F.lit("DQ_016"))  # a row a file
        return shown.join(F.broadcast(declared), ["rule_id", "file"], "left").select(*shown.columns, "suppressed", "suppressed_rules")

"""Many rules in one plan: rules of one form that read one view share its scan.

Forms of SQL rules: single rows (one pass with an array of cases), groups of one key and whole views (one aggregate; what a
rule asks of its rows becomes a FILTER of its own aggregates). Rules about keys (references, unused parents, duplicates)
become rows of (rule, set of keys, key), so that one join answers all of them: keys are counted first, and only those that
are missing, or come twice, are joined with their rows again. A hot key is one row of each task there.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The columns of findings, and their kinds. derived: the finding is there only because of blanks around a cell.
FOUND = {"rule_id": "string", "entity_type": "string", "entity_id": "string", "scope_key": "string", "file": "string", "line": "bigint", "field": "string", "observed_value": "string", "instances": "bigint", "severity": "string", "affected": "bigint", "derived": "boolean"}

_ALONE = re.compile(r"\(SELECT|\bJOIN\b|\bOVER\b|\bDISTINCT\b|\bUNION\b|\bWITH\b|\bWINDOW\b|\bexplode\b|GROUP BY 1|FROM \w+ (?!WHERE|GROUP|HAVING)")
_FORM = re.compile(r"SELECT (?P<id>.+?) AS id, (?P<seen>.+?) AS seen(?:, (?P<line>.+?) AS line)?(?P<own>, line)? FROM (?P<view>\w+)(?: WHERE (?P<where>.+?))?(?: GROUP BY (?P<keys>.+?))?(?: HAVING (?P<having>.+))?")
_AGGREGATE = re.compile(r"\b(?:count|count_if|sum|avg|min|max|min_by|max_by|bool_and|bool_or|median)\(")


@dataclass(frozen=True)
class Form:
    """One rule as parts of a SELECT: rows of a view, or its groups (keys; empty: the whole view)."""

    view: str
    keys: str | None
    id: str
    seen: str
    line: str
    where: str | None
    having: str | None

    @property
    def is_row(self) -> bool:
        return self.keys is None and self.having is None and not _AGGREGATE.search(self.seen)


def form_of(sql: str) -> Form | None:
    """The form of a rule's SQL; None if it needs a plan of its own."""
    m = None if _ALONE.search(sql) else _FORM.fullmatch(sql)
    if m is None:
        return None
    line = m["line"] or ("line" if m["own"] or m["seen"] == "line" else "NULL")
    return Form(m["view"], m["keys"], m["id"], m["seen"], line, m["where"], m["having"])


def only_where(expression: str, condition: str | None) -> str:
    """expression, its aggregates over the rows that meet the condition."""
    if condition is None:
        return expression
    out, at = "", 0
    while m := _AGGREGATE.search(expression, at):
        end = depth = 0
        for end in range(m.end() - 1, len(expression)):
            depth += (expression[end] == "(") - (expression[end] == ")")
            if not depth:
                break
        out += f"{expression[at : end + 1]} FILTER (WHERE {condition})"
        at = end + 1
    return out + expression[at:]


def _finding(rule, form: Form, seen: str, line: str, id_: str) -> str:
    text = lambda x: "CAST(NULL AS STRING)" if x in (None, "-") else f"'{x}'"
    scope = "CAST(NULL AS STRING)" if rule.dedup in ("Feed", "File") else f"CAST({id_} AS STRING)"
    return (
        f"'rule_id', '{rule.rule_id}', 'entity_type', '{rule.table.removesuffix('.txt')}', 'entity_id', CAST({id_} AS STRING), 'scope_key', {scope}, 'file', '{rule.table}', "
        f"'line', CAST({line} AS BIGINT), 'field', {text(rule.plan[1])}, 'observed_value', CAST({seen} AS STRING), 'instances', 1L"
    )


def fused_sql(rules: list[tuple[object, Form]]) -> str:
    """One query for rules of one view and one set of keys (or single rows): an array of findings, taken apart."""
    form, cases = rules[0][1], []
    for rule, f in rules:
        if f.is_row:
            cases.append(f"CASE WHEN {f.where or 'true'} THEN named_struct({_finding(rule, f, f.seen, f.line, f.id)}) END")
        else:
            hit = [f"({only_where(f.having, f.where)})"] if f.having else []
            hit += [f"count(*) FILTER (WHERE {f.where}) > 0"] if f.where and f.keys else []
            seen, line, id_ = (only_where(x, f.where) for x in (f.seen, f.line, f.id))
            cases.append(f"CASE WHEN {' AND '.join(hit) or 'true'} THEN named_struct({_finding(rule, f, seen, line, id_)}) END")
    group = f" GROUP BY {form.keys}" if form.keys else ""
    return f"SELECT inline(filter(found, x -> x IS NOT NULL)) FROM (SELECT array({', '.join(cases)}) AS found FROM {form.view}{group})"


@dataclass(frozen=True)
class Keyed:
    """A rule about the keys of a table: `key` (several columns: all of them), and where else a key must or may be.

    among: the set of keys ((table, column), ...) that is asked; None for duplicates. once: a missing key is reported once.
    """

    rule: object
    table: str
    key: tuple[str, ...]
    entity_type: str
    entity: str
    among: tuple[tuple[str, str], ...] | None
    once: bool = False


def _given(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")).rlike(r"[^\s\p{Z}]")


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def trimmed(table: DataFrame) -> DataFrame:
    """The rows of a table that have blanks around a cell, without these."""
    cells = [c for c in table.columns if c != "line"]
    padded = F.concat_ws("\x00", *cells).rlike(r"(^|\x00)[\s\p{Z}]|[\s\p{Z}](\x00|$)")
    any_blank = F.concat_ws("", *cells).rlike(r"[\s\p{Z}]")  # most rows have none, and end here
    return table.filter(any_blank & padded).select("line", *[_trimmed(F.col(c)).alias(c) for c in cells])


def split_derived(found: DataFrame, padded: DataFrame, again: DataFrame) -> DataFrame:
    """found, where findings of padded rows (file, line) that the trimmed rows don't give again (rule_id, file, line) are derived."""
    told = again.select("rule_id", "file", "line").distinct().withColumn("__again", F.lit(True))
    rows = found.join(padded.select("file", "line").distinct().withColumn("__padded", F.lit(True)), ["file", "line"], "left").join(told, ["rule_id", "file", "line"], "left")
    return rows.withColumn("derived", F.col("__padded").isNotNull() & F.col("__again").isNull()).drop("__padded", "__again")


def _together(parts: list[DataFrame]) -> DataFrame | None:
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out


def _asked(table: DataFrame, rules: list[Keyed], sets: dict) -> DataFrame:
    """A row for each rule and row of a table whose key is given: rule_id, among, key, entity_id, line.

    Each rule reads its own columns: that takes half as long as taking arrays of all rules apart.
    """
    parts = []
    for r in rules:
        key = F.array(*[F.coalesce(F.col(c), F.lit("")) for c in r.key])
        parts.append(table.filter(_given(r.key[0])).select(F.lit(r.rule.rule_id).alias("rule_id"), F.lit(sets[r.among] if r.among else -1).alias("among"), key.alias("key"), F.col(r.entity).alias("entity_id"), "line"))
    return _together(parts)


def _known(views: Callable[[str], DataFrame], sets: dict) -> DataFrame | None:
    """among, key: every key of every set, as often as it comes."""
    pairs = [(t, c, number) for among, number in sets.items() for t, c in among]
    return _together([views(t).filter(F.col(c).isNotNull()).select(F.lit(n).alias("among"), F.array(F.col(c)).alias("key")) for t, c, n in pairs])


def _notice(rows: DataFrame, rules: list[Keyed], line: str, instances: Column) -> DataFrame:
    told = {r.rule.rule_id: (r.entity_type, f"{r.table}.txt", r.key[0], r.rule.dedup not in ("Feed", "File")) for r in rules}
    of = lambda i: F.create_map(*[F.lit(x) for k, v in told.items() for x in (k, v[i])])[F.col("rule_id")]
    return rows.select(
        "rule_id", of(0).alias("entity_type"), "entity_id", F.when(of(3), F.col("entity_id")).alias("scope_key"), of(1).alias("file"),
        F.col(line).alias("line"), of(2).alias("field"), F.get("key", F.lit(0)).alias("observed_value"), instances.cast("long").alias("instances"), "derived",
    )


def key_findings(views: Callable[[str], DataFrame], rules: list[Keyed], keep: Callable[[DataFrame], DataFrame]) -> list[DataFrame]:
    """Findings of all rules about keys. keep writes a table of few rows and reads it again, so that its size is known to the joins after it."""
    sets = {among: i for i, among in enumerate(dict.fromkeys(r.among for r in rules if r.among))}
    tables: dict[str, list[Keyed]] = {}
    for r in rules:
        tables.setdefault(r.table, []).append(r)
    union = lambda of: [p for t, own in tables.items() if (mine := [r for r in own if of(r)]) for p in [_asked(views(t), mine, sets)]]

    def counted(of) -> DataFrame | None:
        asked = _together(union(of))
        return None if asked is None else asked.groupBy("rule_id", "among", "key").agg(F.count(F.lit(1)).alias("rows"), F.min("line").alias("first"))

    # Duplicates and references apart: each row is shuffled for the rules that ask about it only.
    known, twice, asked = _known(views, sets), counted(lambda r: r.among is None), counted(lambda r: r.among is not None)
    bad = keep(_together([*([twice.filter("rows > 1")] if twice else []), *([asked.join(known.distinct(), ["among", "key"], "left_anti").select(asked.columns)] if asked else [])]))
    # A missing key that is there but for blanks around it, on either side.
    bare = F.transform("key", _trimmed)
    if known is None:
        bad = bad.withColumn("derived", F.lit(False))
    else:
        # Of keys that are the same but for blanks, at least one has some: so only keys with blanks, on either side, are trimmed.
        padded = F.exists("key", lambda c: c.rlike(r"^[\s\p{Z}]|[\s\p{Z}]$"))
        meant = known.filter(padded).select("among", bare.alias("bare"))
        own = keep(bad.filter(padded & (F.col("among") >= 0)).select("among", bare.alias("key")).distinct())
        if not own.isEmpty():
            meant = meant.unionByName(known.join(own, ["among", "key"], "left_semi").select("among", F.col("key").alias("bare")))
        meant = meant.distinct().withColumn("found", F.lit(True))
        bad = bad.withColumn("bare", bare).join(meant, ["among", "bare"], "left").withColumn("derived", F.coalesce("found", F.lit(False))).drop("bare", "found")
        bad = keep(bad)
    once = [r for r in rules if r.once]
    out = []
    if once:
        lone = bad.filter(F.col("rule_id").isin(*[r.rule.rule_id for r in once])).withColumn("entity_id", F.get("key", F.lit(0)))
        out.append(_notice(lone, once, "first", F.col("rows")))
    hit = {r["rule_id"] for r in bad.select("rule_id").distinct().collect()}  # rules of the catalogue: tables of the others are not read again
    if rest := [r for r in rules if not r.once and r.rule.rule_id in hit]:
        rows = _together(union(lambda r: r in rest))
        back = rows.join(bad.select("rule_id", "key", "first", "derived"), ["rule_id", "key"]).filter("among >= 0 OR line > first")
        out.append(_notice(back, rest, "line", F.lit(1)))
    return out

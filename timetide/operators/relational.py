"""Relational check templates: keys, references, groups, whole tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block, or of a piece of one, that go to a task together; meetings of sets that are counted at a time.
MOST_ROWS, MEETINGS = 3_000_000, 4_000_000


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Rows of child whose key is set and has no row in parent. Only the key column of parent is read."""
    keys = parent.select(F.col(pk).alias("__pk")).filter(F.col("__pk").isNotNull()).distinct()
    return child.filter(F.col(fk).isNotNull()).join(keys, F.col(fk) == F.col("__pk"), "left_anti")


def missing_keys(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """key, rows: each missing key once. Keys are counted before the join, so a hot key is one row there."""
    counted = child.filter(F.col(fk).isNotNull()).groupBy(F.col(fk).alias("key")).agg(F.count(F.lit(1)).alias("rows"))
    return orphans(counted, "key", parent, pk)


def unused(parent: DataFrame, pk: str, child: DataFrame, fk: str) -> DataFrame:
    """Rows of parent that no row of child refers to."""
    keys = child.select(F.col(fk).alias("__fk")).filter(F.col("__fk").isNotNull()).distinct()
    return parent.filter(F.col(pk).isNotNull()).join(keys, F.col(pk) == F.col("__fk"), "left_anti")


def duplicates(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows after the first of their key, with `nth` (2 and up); null keys are no duplicates."""
    for k in keys:
        df = df.filter(F.col(k).isNotNull())
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("nth", F.row_number().over(w)).filter("nth > 1")


def conflicting(df: DataFrame, keys: list[str], value: str, least: int = 2) -> DataFrame:
    """keys, n_values: keys with so many distinct values or more."""
    return df.groupBy(*keys).agg(F.count_distinct(value).alias("n_values")).filter(F.col("n_values") >= least)


def having(df: DataFrame, keys: list[str], condition: str, **aggregates: Column) -> DataFrame:
    """Groups whose aggregates meet the condition."""
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()]).filter(condition)


def share(df: DataFrame, flag: Column) -> DataFrame:
    """One row: n, hits, ratio (six places; null for no rows) of a table."""
    hits = F.sum(F.when(flag, 1).otherwise(0))
    return df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(hits, F.lit(0)).alias("hits"), F.round(hits / F.count(F.lit(1)), 6).alias("ratio"))


def _overlaps(who: np.ndarray, item: np.ndarray, size: np.ndarray, side: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of sets x, y that may be similar enough, and what they share. who, item: the rows of all sets, by set; side: -1 and 1 meet, sets of 0 each other."""
    listed = side[who] >= 0
    order = np.flatnonzero(listed)[np.argsort(item[listed], kind="stable")]
    owner, asked = who[order], np.flatnonzero(side[who] <= 0)
    begin = np.searchsorted(item[order], np.arange(item.max() + 2)) if len(item) else np.zeros(1, np.int64)
    many = begin[item[asked] + 1] - begin[item[asked]]
    ends = np.cumsum(many)
    # Some sets at a time, whole ones, by how many rows the lists of their items have.
    starts = np.flatnonzero(np.diff(who[asked], prepend=-1))
    before = ends[starts] - many[starts]
    cuts = np.append(starts[np.flatnonzero(np.diff(before // MEETINGS, prepend=-1))], len(asked))
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        n = many[lo:hi]
        at = np.repeat(begin[item[asked[lo:hi]]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        x, y = np.repeat(who[asked[lo:hi]], n), owner[at]
        one = (side[x] != 0) | (x < y)
        met, shared = np.unique(x[one] * len(size) + y[one], return_counts=True)
        x, y = met // len(size), met % len(size)
        near = shared >= (size[x] + size[y]) * (least / (1 + least)) - 1e-6
        yield x[near], y[near], shared[near]


def jaccard_pairs(df: DataFrame, within: str, who: str, item: str, least: float) -> DataFrame:
    """within, a, b, shared, jaccard: pairs a < b of one block whose item sets have at least that similarity (above 0). A null item counts for the size.

    The sets of a block meet in one task, where items list their sets and pairs are counted, so that pairs that share a little are
    never written. A large block (`MOST_ROWS`, or more than a task's share, which is cut into three pieces at most) is dealt into pieces of sets, and
    each two pieces meet: its rows go as often as it has pieces. Two pieces, so a set at least, must fit into a task.
    """
    rows = df.select(F.col(within).alias("block"), F.col(who).alias("who"), F.col(item).alias("item")).filter("block IS NOT NULL AND who IS NOT NULL")
    counted = rows.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.sum("n").alias("total"))  # one row
    tasks = F.col("n") * df.sparkSession.sparkContext.defaultParallelism / F.col("total")
    spread = F.least(F.lit(3), F.ceil((F.sqrt(1 + 8 * tasks) - 1) / 2))
    pieces = F.greatest(spread, F.ceil(F.col("n") / F.lit(MOST_ROWS))).cast("int")
    large = counted.join(F.broadcast(total)).select("block", pieces.alias("pieces")).filter("pieces > 1")  # no more than there are tasks, or MOST_ROWS in all rows
    dealt = rows.join(F.broadcast(large), "block", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("who"), F.col("pieces")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    meet = F.least("own", "other") * F.col("pieces") + F.greatest("own", "other")
    dealt = dealt.select("block", meet.alias("meet"), F.signum(F.col("own") - F.col("other")).cast("int").alias("side"), "who", "item")
    kinds = {f.name: f.dataType.simpleString() for f in dealt.schema}

    def pairs(table):
        sets, items = (pc.dictionary_encode(table.column(c).combine_chunks()) for c in ("who", "item"))
        names, own = sets.dictionary, sets.indices.to_numpy().astype(np.int64)
        code = pc.fill_null(items.indices, len(items.dictionary)).to_numpy().astype(np.int64)
        side = np.zeros(len(names), np.int64)
        side[own] = table.column("side").to_numpy()
        distinct = np.unique(own * (len(items.dictionary) + 1) + code)
        own, code = distinct // (len(items.dictionary) + 1), distinct % (len(items.dictionary) + 1)
        size = np.bincount(own, minlength=len(names))
        given = code < len(items.dictionary)
        found = list(_overlaps(own[given], code[given], size, side, least))
        x, y, shared = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))
        block = pa.repeat(table.column("block")[0], len(x))
        return pa.table([block, names.take(pa.array(x)), names.take(pa.array(y)), pa.array(size[x] + size[y]), pa.array(shared)], ["block", "x", "y", "sizes", "shared"])

    found = dealt.groupBy("block", "meet").applyInArrow(pairs, f"block {kinds['block']}, x {kinds['who']}, y {kinds['who']}, sizes long, shared long")
    value = F.col("shared") / (F.col("sizes") - F.col("shared"))
    return found.filter(value >= least).select(F.col("block").alias(within), F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "shared", F.round(value, 6).alias("jaccard"))

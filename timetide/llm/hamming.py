"""Exact top-k search of binary codes by incremental multi-index hashing (operator 3).

A 64-bit code is cut into `m` segments, each a key into an index of all distinct codes. A query first looks up its own
segments, then all keys at distance 1 from them, then one segment at a time at 2, and so on. With the first i + 1
segments searched up to radius r and the others to r - 1, a code not met yet differs by more than m * r + i in all:
once the k-th verified distance is no more than that, the query's answer is proved and it leaves. Equal codes share one index entry, with the k smallest of their
ids (no other can be among the first k, as ties go by id), so a hot code costs one row.

Radii grow by exploding probes: a probe with its highest changed bit j yields those that also change one bit above j.

Cases: rows with a null id or a null or empty embedding have no code, are in no answer and ask nothing; equal ids with
equal codes count once; a table of fewer than k rows gives all of them; more than 64 dimensions raise ValueError;
extra columns are ignored; an empty table, or none that asks, gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timetide.operators.lineage import cut

BITS = 64


def sign_code(embedding: Column) -> Column:
    """Bits of a vector of up to 64 numbers: 1 where above 0; missing ones at the end are 0."""
    bit = lambda x: F.when(x > 0, F.lit(1)).otherwise(F.lit(0)).cast("long")
    code = F.aggregate(embedding, F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 1).bitwiseOR(bit(x)))
    ok = embedding.isNotNull() & (F.size(embedding) > 0)
    return F.when(ok & (F.size(embedding) > BITS), F.raise_error(F.lit("codes have at most 64 bits"))).when(ok, code)


def segments(n: int) -> list[tuple[int, int]]:
    """(offset, width) of the segments for n codes: about as wide as log2(n), 16 to 32 bits, so that a key has few codes."""
    m = min(4, max(2, round(BITS / max(1.0, math.log2(max(n, 2))))))
    cuts = [BITS * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _key(code: Column, at: tuple[int, int]) -> Column:
    return F.shiftrightunsigned(code, at[0]).bitwiseAND(F.lit((1 << at[1]) - 1))


def top_k(points: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, neighbor_id, distance, rank: of every query (id, code) the k nearest points (id, code), ties by id."""
    points = points.select("id", "code").filter(F.col("id").isNotNull() & F.col("code").isNotNull()).distinct()
    by_code = Window.partitionBy("code").orderBy("id")
    # The rank limit is applied before the shuffle too, so a hot code never meets in one task.
    firsts = cut(points.withColumn("__n", F.row_number().over(by_code)).filter(F.col("__n") <= k).select("code", "id"))
    n = firsts.count()
    enough = min(k, n)
    cuts = segments(n)
    queries = queries.select(F.col("id").alias("query_id"), F.col("code").alias("query")).filter(F.col("query_id").isNotNull() & F.col("query").isNotNull()).distinct()
    places = F.array(*[F.struct(F.lit(i).alias("segment"), _key(F.col("code"), at).alias("key")) for i, at in enumerate(cuts)])
    index = cut(firsts.select("code").distinct().select("code", F.explode(places).alias("place")).select("place.segment", "place.key", "code"))
    found = None
    active = queries.withColumn("worst", F.lit(BITS))
    apart = F.bit_count(F.col("query").bitwiseXOR(F.col("code")))
    for radius, at, covered in _steps(cuts):
        # Verified within the join: what is farther than the k-th so far never leaves it.
        met = _probes(active, cuts, radius, at).join(index, ["segment", "key"]).filter(apart <= F.col("worst")).select("query_id", "query", "code").distinct()
        verified = met.join(firsts, "code").select("query_id", "query", "id", apart.alias("distance"))
        rows = verified if found is None else verified.unionByName(found).distinct()
        order = Window.partitionBy("query_id", "query").orderBy("distance", "id")
        found = cut(rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("rank"))
        state = found.groupBy("query_id", "query").agg(F.count("id").alias("n"), F.max("distance").alias("far")).withColumn("far", F.when(F.col("n") >= enough, F.col("far")))
        after = active.drop("worst").join(state, ["query_id", "query"], "left").filter(F.col("far").isNull() | (F.col("far") > covered))
        active = cut(after.select("query_id", "query", F.coalesce("far", F.lit(BITS)).alias("worst")))
        if active.isEmpty():
            break
    order = Window.partitionBy("query_id", "query").orderBy("distance", "id")
    return found.select("query_id", F.col("id").alias("neighbor_id"), F.col("distance").cast("int"), F.row_number().over(order).cast("int").alias("rank"))


def _steps(cuts: list[tuple[int, int]]) -> Iterator[tuple[int, list[int], int]]:
    """Radius, the segments to search at it, and the distance that is covered afterwards: all segments at once up to 1, then one at a time."""
    m, widest = len(cuts), max(w for _, w in cuts)
    for radius in range(widest + 1):
        if radius < 2:
            yield radius, list(range(m)), m * (radius + 1) - 1
        else:
            for i in range(m):
                # Segments up to i are searched to this radius, the others to one less.
                yield radius, [i], m * radius + i if (radius, i) != (widest, m - 1) else BITS


def _probes(queries: DataFrame, cuts: list[tuple[int, int]], radius: int, segments: list[int]) -> DataFrame:
    """Every key at this very distance from the query's own, in those segments that are wide enough."""
    of = ["query_id", "query", "worst"]
    start = F.array(*[F.struct(F.lit(i).alias("segment"), F.lit(at[1]).alias("width"), _key(F.col("query"), at).alias("key")) for i, at in enumerate(cuts) if i in segments and at[1] >= radius] or [F.struct(F.lit(0).alias("segment"), F.lit(0).alias("width"), F.lit(-1).cast("long").alias("key"))])
    rows = queries.select(*of, F.explode(start).alias("p")).select(*of, "p.segment", "p.width", "p.key", F.lit(-1).alias("top"))
    for _ in range(radius):
        higher = F.when(F.col("top") + 1 < F.col("width"), F.sequence(F.col("top") + 1, F.col("width") - 1))
        rows = rows.withColumn("bit", F.explode(higher))
        rows = rows.withColumn("key", F.col("key").bitwiseXOR(F.expr("shiftleft(1L, bit)"))).withColumn("top", F.col("bit")).drop("bit")
    return rows.select(*of, "segment", "key")


ORACLE = """
SELECT query_id, neighbor_id, distance, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id)::INTEGER AS rank FROM (
    SELECT q.vec_id AS query_id, p.vec_id AS neighbor_id,
           list_sum(list_transform(list_zip(q.embedding, p.embedding), lambda x: ((x[1] > 0) <> (x[2] > 0))::INT))::INTEGER AS distance
    FROM embeddings q, embeddings p WHERE q.vec_id % 100 = 0))
WHERE rank <= 10
"""

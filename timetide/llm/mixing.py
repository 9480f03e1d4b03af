"""Mixing sources to target weights by systematic sampling (operator 6).

Targets: the sources, by code point with null last, weigh 5, 2, 1, repeating, and share the words of the whole
table; a target stops at `MOST` times its source's words, and the excess is shared again by weight. The fixed point
is a water level: with sources by cap over weight, the first level that no longer lifts the next source over its cap.

Sampling: each document of a source expects target / source_size copies. Within the source the documents stand
by size class, then by a hash of their id; the running sum of the expected copies plus one random offset a source
crosses some integer boundaries within each document, and each crossing is one copy. As all size classes are taken
at the same rate, the words taken come near the target.

The running sum never gathers a source in one task: it is the rank times the rate, and ranks come from counts of
(source, size class, slice of the hash) plus a rank within such a slice, of about `PER_SLICE` documents. The offset has 20
bits, so at a rate of exactly 3 all sums are exact, and no document is taken more than 3 times.

Cases: a null text has size 0; very long texts are counted whole; a null source is a source, the last; a source without
words has target 0 and nothing is taken; repeated rows are ranked one by one; ties in size and id go either way, with
the same sums; a null doc_id stands by the md5 of its text; an empty table gives an empty result; all other columns are
kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timetide.operators.lineage import cut

WEIGHTS = (5, 2, 1)
MOST = 3
SLICES, PER_SLICE = 256, 20_000
#: Steps of the offset.
STEPS = 1 << 20


def n_words(text: Column) -> Column:
    """How many `[^\\x20\\x09-\\x0D]+` a text has: its places where a word starts."""
    blanks = " \t\n\x0b\f\r"
    folded = F.translate(F.coalesce(text.cast("string"), F.lit("")), blanks, " " * len(blanks))
    return F.coalesce(F.size(F.filter(F.split(folded, " "), lambda w: w != "")), F.lit(0)).cast("long")


def unit_hash(x: Column) -> Column:
    """A number in [0, 1) from the md5 of a text: SQL engines agree on it."""
    return F.conv(F.substring(F.md5(x), 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target of a table with one row a source (source, source_size).

    The windows without a key see one row a source, after all documents have been aggregated.
    """
    everything = Window.partitionBy()
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1)
    t = sizes.withColumn("weight", weight).withColumn("cap", MOST * F.col("source_size"))
    by_ratio = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    # All sources before this one stand at their caps: what is left, over the weight that is left, is the level.
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    t = t.withColumn("level", level).withColumn("nth", F.row_number().over(by_ratio))
    t = t.withColumn("final", F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct("nth", "level"))).over(everything)["level"])
    # `final` is null only where no source has words.
    target = F.when(F.col("final").isNull(), F.lit(0.0)).otherwise(F.least(F.col("cap").cast("double"), F.col("final") * F.col("weight")))
    return t.select("source", "source_size", target.alias("target"))


def copies(docs: DataFrame, doc_id: str, source: str, text: str, size: str, seed: str = "mix") -> DataFrame:
    """The rows of docs with mix_size, mix_target and mix_copies (how often the mix takes the document); the names say which columns count."""
    of_id = F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("t"), F.md5(F.col(text).cast("string").cast("binary"))), F.lit(""))
    d = docs.withColumns({"mix_source": F.col(source).cast("string"), "mix_class": F.floor(F.log2(F.col(size) + 1) * 4).cast("int"), "mix_id": of_id, "mix_hash": unit_hash(F.concat(F.lit(seed + ":"), of_id))})
    # As many slices as the table needs: a slice of a class is ranked in one task.
    slices = max(SLICES, docs.count() // PER_SLICE)
    d = d.withColumn("mix_slice", F.floor(F.col("mix_hash") * slices).cast("int"))
    counts = cut(d.groupBy("mix_source", "mix_class", "mix_slice").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("words")))
    aimed = targets(counts.groupBy(F.col("mix_source").alias("source")).agg(F.sum("words").alias("source_size"))).withColumnRenamed("source", "s")
    # Counts by class come before those by slice, so no window holds more than the slices of a class or the classes of a source.
    in_class = Window.partitionBy("mix_source", "mix_class").orderBy("mix_slice").rowsBetween(Window.unboundedPreceding, -1)
    classes = counts.groupBy(F.col("mix_source").alias("s2"), F.col("mix_class").alias("c2")).agg(F.sum("n").alias("n2"))
    classes = classes.select("s2", "c2", F.coalesce(F.sum("n2").over(Window.partitionBy("s2").orderBy("c2").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    known = counts.withColumn("before", F.coalesce(F.sum("n").over(in_class), F.lit(0)))
    known = known.join(classes, F.col("mix_source").eqNullSafe(F.col("s2")) & (F.col("mix_class") == F.col("c2"))).join(aimed, F.col("mix_source").eqNullSafe(F.col("s")))
    known = known.select(F.col("mix_source").alias("mix_s"), F.col("mix_class").alias("mix_c"), F.col("mix_slice").alias("mix_l"), (F.col("before") + F.col("earlier")).alias("mix_before"), F.col("source_size").alias("mix_size"), F.col("target").alias("mix_target"))
    d = d.join(known, F.col("mix_source").eqNullSafe(F.col("mix_s")) & (F.col("mix_class") == F.col("mix_c")) & (F.col("mix_slice") == F.col("mix_l"))).drop("mix_s", "mix_c", "mix_l")
    rank = F.col("mix_before") + F.row_number().over(Window.partitionBy("mix_source", "mix_class", "mix_slice").orderBy("mix_hash", "mix_id", F.col(size)))
    rate = F.when(F.col("mix_size") > 0, F.col("mix_target") / F.col("mix_size")).otherwise(F.lit(0.0))
    offset = F.floor(unit_hash(F.concat(F.lit(seed + "/"), F.coalesce(F.col("mix_source"), F.lit("")))) * STEPS) / STEPS
    d = d.withColumns({"mix_rank": rank, "mix_rate": rate, "mix_offset": offset})
    crossed = F.floor(F.col("mix_offset") + F.col("mix_rank") * F.col("mix_rate")) - F.floor(F.col("mix_offset") + (F.col("mix_rank") - 1) * F.col("mix_rate"))
    return d.withColumn("mix_copies", F.least(crossed.cast("long"), F.lit(MOST).cast("long")))


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (copies times size) of every row; the texts are read once."""
    text = F.when(F.col("doc_id").isNull(), F.col("text").cast("string"))
    rows = cut(docs.select("doc_id", F.col("source").cast("string").alias("source"), text.alias("text"), n_words(F.col("text")).alias("size")))
    taken = copies(rows, "doc_id", "source", "text", "size")
    return taken.select("doc_id", "source", "size", F.col("mix_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_copies").alias("copies"), (F.col("mix_copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken."""
    own, at = docs.columns, [f"c{i}" for i in range(len(docs.columns))]  # by place, so that no name of docs can clash
    place = dict(zip(own, at, strict=True))
    rows = docs.toDF(*at).withColumn("mix_words", n_words(F.col(place["text"])))
    d = copies(rows, place["doc_id"], place["source"], place["text"], "mix_words")
    # Documents that are taken more than once are repeated by an array of so many places, at most MOST.
    return d.filter(F.col("mix_copies") > 0).withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int")))).select(*at).toDF(*own)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         coalesce(doc_id::VARCHAR, 't' || md5(text), '') AS oid
  FROM documents),
h AS (
  SELECT *, floor(log2(size + 1) * 4)::INT AS class, (('0x' || md5('mix:' || oid)[1:12])::BIGINT) / 281474976710656.0::DOUBLE AS hash
  FROM d),
r AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, hash, oid, size) AS rank,
         floor((('0x' || md5('mix/' || coalesce(source, ''))[1:12])::BIGINT) / 281474976710656.0::DOUBLE * 1048576) / 1048576 AS off
  FROM h),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS cap
  FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS level,
         row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS nth
  FROM w WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, arg_min(level, nth) FILTER (WHERE level <= cap / weight) OVER () AS final FROM l),
t AS (SELECT source, source_size, CASE WHEN final IS NULL THEN 0.0 ELSE least(cap::DOUBLE, final * weight) END AS target FROM f)
SELECT doc_id, size, t.source_size, t.target,
       (size * least(3, floor(off + rank * rate) - floor(off + (rank - 1) * rate)))::BIGINT AS taken
FROM r JOIN (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM t) t
  ON r.source IS NOT DISTINCT FROM t.source
"""

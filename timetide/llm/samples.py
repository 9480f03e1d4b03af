"""Bounded samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPREAD = 1 << 30


def sample_by_class(rows: DataFrame, label: str, key: str, per_class: int) -> DataFrame:
    """About per_class rows of every label, chosen by a hash of the key: the same rows on every run.

    One small aggregate counts the labels; the bound holds in expectation whatever the size of the input.
    """
    counts = rows.groupBy(label).count().collect()
    keep = F.lit(False)
    for value, n in counts:
        part = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(17)), F.lit(SPREAD)) < int(min(1.0, per_class / n) * SPREAD)
        keep = keep | ((F.col(label) == value) & part)
    return rows.filter(keep)


def spread(text: Column, chars: int, pieces: int = 20) -> Column:
    """text, or where it is longer than chars, so many pieces from all over it that are chars together."""
    n = F.length(text)
    starts = F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), lambda i: (F.floor(i.cast("long") * n / pieces) + 1).cast("int"))
    return F.when(n <= chars, text).otherwise(F.array_join(F.transform(starts, lambda at: F.substring(text, at, F.lit(chars // pieces))), " "))

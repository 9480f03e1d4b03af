"""Runs of repeated words, and texts without the repeats (operator 11).

The words of a text become numbers in the order of their first use, compared only by < and = (an ordered alphabet). For
that order and for its reverse, the Lyndon array is found as the edges from each suffix to the next smaller one, by one
scan from left to right over the chain of smaller suffixes before the current one. Comparisons reuse what was matched
before: of the match that reaches furthest to the right (`low`, `high` up to `reach`), every later comparison that ends
before `reach` repeats one at `low`, so it is copied with all that it closed; a comparison that gets to `reach` goes on
from there. So a word is matched once at most, beside one mismatch a comparison: linear in the text, without suffix
structures and hashes.

Each run has a Lyndon root in one of the two orders, whose edge spans one period and matches to the end of the run. A run
of at least four periods leaves more than two of them matched behind its first root; those edges are the candidates, and
the first one of a run is followed to the left for less than one period.

Cases: a null or blank text has no words and no runs, and collapses to the empty text; repeated rows give repeated rows;
runs that overlap or start together are all listed, and a word goes if any of them repeats it; texts may be of any length
(a task holds one block of texts, or one longer text); an empty table gives no rows; other columns are ignored. A null
doc_id counts as the empty text where `repeat_tails` draws what to repeat.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timetide.llm.textops import crc_of_id, doc_id_type, map_texts, texts_of

#: A run has at least so many words and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4


def lyndon_edges(word: list[int]) -> tuple[list[int], list[int], list[int]]:
    """For each suffix of word, where the next smaller suffix starts (0: nowhere) and on how many words the two agree;
    and the suffixes that agree with their next smaller one on more than twice the words between them.

    word ends with a number below all others, so no suffix is a beginning of another one.
    """
    n = len(word)
    after, agree = [0] * n, [0] * n
    before, behind = [-1] * n, [0] * n  # the same towards the smaller suffix below on the chain
    longest = [0] * n  # most words on which a suffix agreed with any that it was compared with
    periodic: list[int] = []
    chain: list[int] = []
    push, pop = chain.append, chain.pop
    low = high = reach = 0
    for i in range(n):
        if i >= reach:
            # Nothing is known of what follows here.
            a, b = word[i], -n - 2
            while chain:
                j = chain[-1]
                b = word[j]
                if b <= a:
                    break
                after[pop()] = i
            if not chain or b < a:
                before[i] = chain[-1] if chain else -1
                push(i)
                continue
            m = 1
        else:
            moved = high - low
            like = i - moved
            if i + longest[like] < reach:
                # All comparisons end within what was matched: they are those of `like`.
                stop = before[like] + moved
                while chain[-1] > stop:
                    j = pop()
                    after[j] = i
                    agree[j] = m = agree[j - moved]
                    if m > 2 * (i - j):
                        periodic.append(j)
                before[i], behind[i], longest[i] = stop, behind[like], longest[like]
                push(i)
                continue
            # One of them gets to `reach`: those before it are as at `like`, and it goes on from there.
            while True:
                j = chain[-1]
                m = agree[j - moved] if after[j - moved] == like else behind[like]
                if i + m >= reach:
                    m = reach - i
                    break
                after[pop()] = i
                agree[j] = m
                if m > 2 * (i - j):
                    periodic.append(j)
        # Suffix j, on top of the chain, and suffix i agree on m words or more.
        while True:
            while word[j + m] == word[i + m]:
                m += 1
            if i + m >= reach:
                low, high, reach = j, i, i + m
            if word[j + m] < word[i + m]:
                before[i], behind[i] = j, m
                break
            after[pop()] = i
            agree[j] = m
            if m > 2 * (i - j):
                periodic.append(j)
            same = behind[j]
            # Suffixes below that agree with j on more words differ from i where j does.
            while chain and same > m:
                j = pop()
                after[j] = i
                agree[j] = m
                if m > 2 * (i - j):
                    periodic.append(j)
                same = behind[j]
            if not chain:
                break
            j = chain[-1]
            if same < m:
                before[i], behind[i] = j, same
                break
        longest[i] = m
        push(i)
    return after, agree, periodic


def runs_of(word: list[int]) -> list[tuple[int, int, int]]:
    """start, length and smallest period of every run of word (numbers from 0 on), by start and period."""
    end, found = -len(word) - 1, set()
    for order in (word, [-a for a in word]):
        after, agree, periodic = lyndon_edges([*order, min(end, -max(word, default=0) - 1)])
        for i in periodic:
            period = after[i] - i
            if i >= period and after[i - period] == i and agree[i - period] >= period:
                continue  # not the first root of its run
            start, last = i, i + period + agree[i]
            while start and word[start - 1] == word[start - 1 + period]:
                start -= 1
            if last - start >= max(LEAST_WORDS, LEAST_PERIODS * period):
                found.add((start, last - start, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes]) -> tuple[list[tuple[int, int, int]], list[bytes]]:
    """The runs of words, and the words that no run repeats: a run keeps its first period only."""
    first: dict[bytes, int] = {}
    found = runs_of(list(map(first.setdefault, words, range(len(words)))))
    if not found:
        return found, words
    gone = np.zeros(len(words), bool)
    for start, length, period in found:
        gone[start + period : start + length] = True
    return found, [words[i] for i in np.flatnonzero(~gone).tolist()]


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, runs (array of start, length, period, by start and period) and collapsed (the kept words, one space between) of every row."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        told = [collapse((t or b"").split()) for t in part.column("text").to_pylist()]
        runs = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in found] for found, _ in told]
        kind = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(runs, kind), pa.array([b" ".join(kept) for _, kept in told], pa.binary())], ["doc_id", "runs", "collapsed"])

    rows = map_texts(texts_of(docs, "doc_id"), run, f"doc_id {doc_id_type(docs)}, runs array<struct<start: long, length: long, period: long>>, collapsed binary")
    return rows.withColumn("collapsed", F.col("collapsed").cast("string"))


def repeat_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text, where a tenth of the texts (by crc32 of the id, h) repeats a stretch of its words up to its end.

    Of n words, g = floor(h / 10), from word a = g % n on the p = 1 + floor((n - a) / (3 + g % 8)) words from a come again and again.
    """
    h = crc_of_id()
    parts = F.filter(F.split(F.col("text").cast("string"), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def repeated(words):
        n, g = F.size(words).cast("long"), F.floor(h / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        at = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.when(i < a, i).otherwise(a + (i - a) % p))
        return F.when(n > 0, F.array_join(F.transform(at, lambda i: F.get(words, i.cast("int"))), " "))

    # The words are cut once: as the only entry of an array that is gone through.
    return docs.select("doc_id", F.when(h % 10 == 0, F.get(F.transform(F.array(parts), repeated), F.lit(0))).otherwise(F.col("text").cast("string")).alias("text"))


def digests(rows: DataFrame) -> DataFrame:
    """One row a document of `periodic_runs` with its longest run (ties: the first, then the shortest period) and digests."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return rows.withColumn("top", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("top.start")).alias("start"),
        F.col("top.length").alias("length"),
        (-F.col("top.period")).alias("period"),
        F.expr("1000 * top.length div -top.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )

"""Pairs of similar sets: against brute force, and what they shuffle."""

import random

import pytest
from shuffles import rows_shuffled

from timetide.operators import relational


@pytest.mark.parametrize("least", [0.1, 0.15, 0.5, 0.8, 1.0])
def test_pairs_against_brute_force(spark, least):
    """Blocks of loose sets, copies with a few items more or less, subsets, and sets of one item."""
    draw = random.Random(f"pairs {least}")
    sets = {}
    for block in range(4):
        for who in range(30):
            own = [s for (b, _), s in sets.items() if b == block]
            near = set(draw.choice(own)) if own and draw.random() < 0.6 else {min(draw.randrange(90), draw.randrange(90)) for _ in range(draw.choice([1, 2, 9, 30]))}
            near = set(draw.sample(sorted(near), draw.randint(max(1, len(near) * 2 // 3), len(near)))) | {draw.randrange(90) for _ in range(draw.choice([0, 0, 1, 5]))}
            sets[block, who] = near
    rows = [(b, w, i) for (b, w), s in sets.items() for i in s for _ in range(draw.choice([1, 1, 2]))]
    wanted = set()
    for (b, w), s in sets.items():
        for (c, x), t in sets.items():
            if b == c and w < x and len(s & t) / len(s | t) >= least:
                wanted.add((b, w, x, len(s & t), round(len(s & t) / len(s | t), 6)))
    found = relational.jaccard_pairs(spark.createDataFrame(rows, "block int, who long, item long"), "block", "who", "item", least)
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == wanted and wanted


def test_sets_that_share_a_little_are_not_joined_again(spark):
    """40 sets of 300 items, any two with a few in common: not every pair of them meets all the items of a set."""
    draw = random.Random("a little")
    rows = [(0, who, item) for who in range(40) for item in draw.sample(range(10_000), 300)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # large tables
    try:
        found = relational.jaccard_pairs(spark.createDataFrame(rows, "block int, who long, item long"), "block", "who", "item", 0.15)
        assert not found.collect()
        assert 2 * len(rows) < rows_shuffled(found) < 12 * len(rows)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pairs_that_share_a_little_are_not_shuffled(spark):
    """300 sets of 40 items of 400: each two share some, and none of these pairs goes through a shuffle."""
    draw = random.Random("pairs")
    rows = [(0, who, item) for who in range(300) for item in draw.sample(range(400), 40)] + [(0, 300 + who, item) for who in range(2) for item in range(400, 440)]
    found = relational.jaccard_pairs(spark.createDataFrame(rows, "block int, who long, item long"), "block", "who", "item", 0.5)
    assert [tuple(r) for r in found.collect()] == [(0, 300, 301, 40, 1.0)]
    assert rows_shuffled(found) < 4 * len(rows)


def test_blocks_in_pieces_texts_and_nulls(spark, monkeypatch):
    """Pieces of a few rows; sets and items of texts; a null item counts for the size, rows without block or set for nothing."""
    monkeypatch.setattr(relational, "MOST_ROWS", 5)
    rows = [("x", w, i) for w, own in {"b": "pqrs", "a": "pqr", "c": "pq", "d": "stuvw", "e": "q"}.items() for i in own] + [("x", "c", None), ("x", "c", None), (None, "a", "p"), ("x", None, "p"), ("y", "a", "p")]
    found = relational.jaccard_pairs(spark.createDataFrame(rows, "block string, who string, item string"), "block", "who", "item", 0.4)
    assert sorted(map(tuple, found.collect())) == [("x", "a", "b", 3, 0.75), ("x", "a", "c", 2, 0.5), ("x", "b", "c", 2, 0.4)]

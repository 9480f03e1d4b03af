"""What op7 keeps of a corpus that is too large for a sketch of all its shingles."""

import random

from timetide.llm import jaccard, substrings


def test_sets_of_single_shingles_leave_however_many_there_are(spark, monkeypatch):
    """2,000 unlinked texts, a third of each common to all, and 40 near copies: more shingles than cells of a sketch."""
    monkeypatch.setattr(substrings, "MOST_CELLS", substrings.LEAST_CELLS)
    draw = random.Random("large")
    common = [f"c{i}" for i in range(40)]
    texts = [" ".join(common + [f"w{draw.randrange(10**6)}" for _ in range(80)]) for _ in range(2000)]
    near = [t.rsplit(" ", 1)[0] + " changed" for t in texts[:40]]
    docs = spark.createDataFrame(list(enumerate(texts + near)), "doc_id long, text string").repartition(7)
    rows, n = jaccard.described(docs, 5, 80)
    kept = {r.doc_id for r in rows.filter("own IS NOT NULL").select("doc_id").collect()}
    assert n == 2040 and {*range(40), *range(2000, 2040)} <= kept and len(kept) < 200
    found = {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()}
    assert found == {**{i: i for i in range(2000)}, **{2000 + i: i for i in range(40)}}


def test_small_and_empty_sets_stay(spark):
    """Sets of one to four words, equal ones, a null and a blank text beside one of many repeats."""
    texts = ["a", "A", "a b", "a b c d", "a b c d", None, " ", "x y " * 500, "x y " * 400]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()}
    assert got == {0: (1, 0), 1: (1, 0), 2: (1, 2), 3: (1, 3), 4: (1, 3), 5: (0, 5), 6: (0, 6), 7: (2, 7), 8: (2, 7)}

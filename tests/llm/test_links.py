"""All links of the n-gram Jaccard join against brute force, those inside a component too."""

import random

import pytest
from pyspark.sql import functions as F

from timetide.llm import jaccard


def shingles(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    w = [f"w{i}" for i in range(104)]
    chain = [w[k : k + 84] for k in (0, 8, 16, 20)]  # neighbours link, the ends don't
    texts = [" ".join(x) for x in chain]
    base = [f"b{rng.randint(0, 900)}" for _ in range(90)]
    for _ in range(40):
        x = list(base)
        for _ in range(rng.randint(0, 4)):
            x[rng.randrange(len(x))] = "y" + str(rng.randint(0, 9))
        texts.append(" ".join(x))
    texts += [" ".join(f"z{rng.randint(0, 900)}" for _ in range(rng.randint(1, 60))) for _ in range(20)]
    texts += [texts[1], texts[1].upper(), texts[9], "", None, "one two"]
    return list(enumerate(texts)) + [(None, texts[2]), (None, None)]


def test_links_against_brute_force(spark, rows):
    docs, sets = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), [shingles(t) for _, t in rows]
    link = lambda x, y: bool(x) and 100 * len(x & y) >= 80 * len(x | y)
    wanted = sorted((str(d), len(s), sum(link(s, o) for j, o in enumerate(sets) if j != i)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))
    assert sorted((str(r.doc_id), r.n_shingles, r.n_links) for r in jaccard.link_counts(docs).collect()) == wanted
    assert link(sets[0], sets[1]) and link(sets[1], sets[2]) and not link(sets[0], sets[2])
    rep = {}
    for (d, _), s in zip(rows, sets, strict=True):
        if s and d is not None:
            rep[frozenset(s)] = min(d, rep.get(frozenset(s), d))
    classes = list(rep)
    pairs = {tuple(sorted((rep[x], rep[y]))) for i, x in enumerate(classes) for y in classes[i + 1 :] if link(x, y)}
    found = jaccard.links(docs).collect()
    assert {tuple(sorted((r.rep_a, r.rep_b))) for r in found} == pairs and len(found) == len(pairs)
    assert jaccard.link_counts(docs.limit(0)).count() == 0


def test_pieces_of_a_list_lose_and_repeat_no_pair(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    posting = jaccard._prepared(docs, 5, 80)[2]
    whole, cut_up = (sorted(map(tuple, jaccard.candidates(posting, 80, piece).collect())) for piece in (10_000, 3))
    assert whole == cut_up and len(whole) == len(set(whole)) > 0

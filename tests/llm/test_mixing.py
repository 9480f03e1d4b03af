"""Targets against the rule as it is told (reshare until none is above), copies against their bounds."""

import random

from timetide.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string"


def reshared(sizes: dict) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if share[s] > 3 * sizes[s]]
        if not above:
            return fixed | share
        fixed |= {s: 3 * sizes[s] for s in above}


def rows(seed: int, sources: list, n: int) -> list:
    rng = random.Random(seed)
    return [(i, " ".join("w" for _ in range(rng.randint(0, 40))), "en", rng.choice(sources), 1, "x") for i in range(n)]


def test_targets_and_copies(spark):
    for seed, sources in ((1, ["a", "b", None]), (2, ["a"] * 30 + ["b", "c", "d", "é", None]), (3, ["a"]), (4, ["a"] + ["b"] * 50)):
        data = rows(seed, sources, 600)
        docs = spark.createDataFrame(data, SCHEMA)
        got = mixing.mix_report(docs).collect()
        sizes = {}
        for _, text, _, source, _, _ in data:
            sizes[source] = sizes.get(source, 0) + len(text.split())
        want = reshared(sizes)
        assert len(got) == len(data)
        taken = dict.fromkeys(sizes, 0)
        for r in got:
            assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
            assert 0 <= r.taken <= 3 * r.size
            taken[r.source] += r.taken
        for s, t in taken.items():
            assert abs(t - want[s]) <= 0.02 * sum(sizes.values()), (s, t, want[s])
        mixed = mixing.mix(docs)
        assert mixed.columns == docs.columns
        assert mixed.count() == sum(r.copies for r in got)
        assert sorted(got) == sorted(mixing.mix_report(docs.repartition(7)).collect())


def test_edges(spark):
    docs = spark.createDataFrame([(None, None, None, None, None, None), (1, "", None, "a", 0, "x"), (1, "", None, "a", 0, "x")], SCHEMA)
    got = mixing.mix_report(docs).collect()
    assert [(r.size, r.taken, r.target) for r in got] == [(0, 0, 0.0)] * 3
    assert mixing.mix_report(docs.limit(0)).count() == 0


def test_rate_of_exactly_three_and_clashing_names(spark):
    data = [(None if i % 7 == 0 else i, "w " * (1 + i % 5), "x", "a", 1, "s") for i in range(3000)] + [(9000 + i, "v " * 400, "x", "b", 1, "s") for i in range(120)]
    docs = spark.createDataFrame([(*r, "own", 5) for r in data], SCHEMA + ", __size string, mix_x long")
    got = mixing.mix_report(docs).collect()
    rate = {r.source: r.target / r.source_size for r in got}
    assert rate["a"] == 3.0 and {r.copies for r in got if r.source == "a"} == {3}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.filter("source = 'a'").count() == 9000 and {r["__size"] for r in mixed.collect()} == {"own"}

"""Score deltas against brute force: every root and all that it causes taken out, and the scores worked out anew."""

import random

from timetide.plans import notices as N

RULES = [
    ("A", "Critical", "Spec", "Entity", 1, 1, ["B", "C"]),
    ("B", "High", "Interop", "Entity", 1, 1, ["D"]),
    ("C", "Medium", "Quality", "Row", 2, 1, []),
    ("D", "Low", "Analytics", "Row", 1, 1, []),
    ("E", "Critical", "Spec", "Feed", 3, 1, ["D"]),
    ("F", "Low", "Quality", "Row", 1, 0, []),
]
RULE_SCHEMA = "rule_id string, severity string, rule_class string, dedup string, base_effort int, score_weight int, blocks array<string>"
SCHEMA = "rule_id string, entity_type string, entity_id string, scope_key string, file string, line long, field string, observed_value string, instances long"


def rise(rows):
    rules = {r[0]: r for r in RULES}
    factor = lambda n: 1.0 if n <= 5 else 1.5 if n <= 50 else 2.0
    weight = lambda r: N.SEVERITY_WEIGHTS[rules[r][1]] * rules[r][5]
    total = lambda kept: {r: sum(n for k, _, n in kept if k == r) for r in rules}
    penalty = lambda counts: {r: weight(r) * factor(n) if n else 0 for r, n in counts.items()}
    score = lambda x: 5000 / (50 + x)

    def overall(p):
        return sum(w * score(sum(v for r, v in p.items() if rules[r][2] == c)) for c, w in N.CLASS_WEIGHTS.items())

    blocks = lambda a, b: b[0] in rules[a[0]][6] and (a[1] is None or a[1] == b[1])
    pairs = {(r, s) for r, s, _ in rows}
    roots = {b for b in pairs if not any(blocks(a, b) for a in pairs)}
    out = {}
    for rule in {r for r, _ in roots}:
        gone = todo = {x for x in roots if x[0] == rule}
        while todo:
            todo = {b for b in pairs if any(blocks(a, b) for a in todo)} - gone
            gone = gone | todo
        kept = [x for x in rows if (x[0], x[1]) not in gone]
        taken = total([x for x in rows if (x[0], x[1]) in gone])
        now = penalty(total(rows))
        publish = sum(now[r] for r in rules if rules[r][1:3] == ("Critical", "Spec"))
        off = sum(weight(r) * factor(taken[r]) for r in rules if rules[r][1:3] == ("Critical", "Spec") and taken[r])
        out[rule] = (overall(penalty(total(kept))) - overall(now), score(max(publish - off, 0)) - score(publish))
    return out


def test_deltas(spark):
    rng = random.Random(2)
    rules = spark.createDataFrame(RULES, RULE_SCHEMA)
    for size in (8, 60):
        rows = [(rng.choice("ABCDEF"), rng.choice([None, "x", "y", "z"]), rng.choice([1, 3, 9])) for _ in range(size)]
        found = spark.createDataFrame([(r, "t", str(i), s, "f.txt", i, None, None, n) for i, (r, s, n) in enumerate(rows)], SCHEMA)
        got = {r.rule_id: (r.score_delta, r.publish_delta) for r in N.score_deltas(found, rules).collect()}
        wanted = rise(rows)
        assert got.keys() == wanted.keys()
        for rule, (score, publish) in wanted.items():
            assert abs(got[rule][0] - score) <= 0.0501 and abs(got[rule][1] - publish) <= 0.0501

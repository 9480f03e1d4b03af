"""Operator 11 against brute force: edges of the Lyndon array, runs, and the query over odd rows."""

import hashlib
import random
import re
import zlib

import pytest

from timetide.llm import registry, runs


def strings(seed, many):
    rng = random.Random(seed)
    for _ in range(many):
        letters, w = rng.randint(1, 4), []
        size = rng.randint(0, 90)
        while len(w) < size:
            root = [rng.randrange(letters) for _ in range(rng.randint(1, 6))]
            w += (root * rng.randint(1, 7))[: rng.randint(1, 60)]
            if rng.random() < 0.3:
                w += w[rng.randrange(len(w)) :]
        yield w[:size]


def plain_edges(word):
    n = len(word)
    after, agree = [0] * n, [0] * n
    for i in range(n):
        for j in range(i + 1, n):
            if word[j:] < word[i:]:
                m = 0
                while j + m < n and word[i + m] == word[j + m]:
                    m += 1
                after[i], agree[i] = j, m
                break
    return after, agree


def plain_runs(word):
    """Maximal stretches of each period, smallest period first."""
    n, found = len(word), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if word[i] != word[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and word[i] == word[i + q]:
                i += 1
            length = i - start + q
            if length >= max(6, 4 * q):
                found.setdefault((start, length), q)
    return sorted(((s, k, q) for (s, k), q in found.items()), key=lambda r: (r[0], r[2]))


def test_edges_and_runs():
    for w in strings(1, 3000):
        closed = [*w, -len(w) - 9]
        after, agree, periodic = runs.lyndon_edges(closed)
        assert (after, agree) == plain_edges(closed)
        assert sorted(periodic) == [i for i, (j, m) in enumerate(zip(after, agree)) if m > 2 * (j - i) > 0]
        assert runs.runs_of(w) == plain_runs(w)


class Counted(int):
    """A number that counts how often it is compared."""

    compared = 0

    def _count(name):
        def compare(self, other):
            Counted.compared += 1
            return getattr(int, name)(self, other)

        return compare

    __eq__, __lt__, __le__, __gt__, __ge__ = map(_count, ("__eq__", "__lt__", "__le__", "__gt__", "__ge__"))
    __hash__ = int.__hash__


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("w", [[0] * 6000, fibonacci(6000), ([0] * 50 + [1]) * 120, (fibonacci(300) * 20), [i % 7 for i in range(6000)]])
def test_comparisons_are_linear(w):
    Counted.compared = 0
    runs.lyndon_edges([*map(Counted, w), Counted(-len(w) - 9)])
    assert Counted.compared <= 6 * len(w)


def planted(doc_id, words):
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def expected(doc_id, text):
    words = planted(doc_id, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    first = {}
    found = plain_runs([first.setdefault(w, i) for i, w in enumerate(words)])
    gone = {i for s, k, q in found for i in range(s + q, s + k)}
    top = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    figures = (top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4
    listed = "".join(f"{s},{k},{q}\n" for s, k, q in found)
    return (doc_id, len(found), *figures, sha(listed), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


SCHEMA = "doc_id long, text string, runs string, collapsed long, start int, top string"


def test_query_over_odd_rows(spark, tmp_path):
    rng = random.Random(3)
    texts = [" ".join(map(str, w)) for w in strings(8, 150)]
    texts += ["", " \n\t ", None, "x", "a b  a\tb a b\na b a b", "é 日本 " * 9, "a " * 7000, " ".join(str(i % 900) for i in range(9000)), "a\x0bb\x0ca\rb a b a b", "a\xa0b " * 6, "y\x00 " * 6]
    rows = [(i, t, "x", 1, 2, "y") for i, t in enumerate(texts)]
    # Ids whose texts are made to repeat, with the longest of texts too.
    rows += [(i, " ".join(str(rng.randrange(40)) for _ in range(rng.randint(1, 300))), None, None, None, None) for i in range(1000, 1200) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows += [rows[4], (None, "a b " * 8, None, None, None, None), (None, None, None, None, None, None)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["op11_periodic_runs"](spark, str(tmp_path))
    assert got.dtypes == [("doc_id", "bigint"), ("n_runs", "bigint"), ("start", "bigint"), ("length", "bigint"), ("period", "bigint"), ("exponent_milli", "bigint"), ("runs_sha256", "string"), ("collapsed_sha256", "string")]
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted((expected(r[0], r[1]) for r in rows), key=key)


def test_operator_gives_runs_and_text(spark):
    rows = spark.createDataFrame([(1, "go a b a b a b a b on")], "doc_id long, text string")
    (r,) = runs.periodic_runs(rows).collect()
    assert [tuple(x) for x in r.runs] == [(1, 8, 2)] and r.collapsed == "go a b on"
    assert runs.periodic_runs(rows.limit(0)).collect() == [] and runs.digests(runs.periodic_runs(rows.limit(0))).collect() == []

"""Operator 13 against numpy's eigenvectors and exact integers, and on odd rows."""

import math
import random

import numpy as np
import pytest

from timetide.llm import registry, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, component string, n int"


def vectors(seed, n, dims):
    rng = np.random.default_rng(seed)
    spread = rng.normal(size=(dims, dims))
    return (rng.normal(size=(n, dims)) @ spread / 9).astype(np.float32)


def table(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{path}/embeddings.parquet")
    return registry.QUERIES["op13_whitening"](spark, str(path))


def check(got, ids, values, k=8):
    """got against exact sums and numpy's eigenvectors, row by row."""
    x = [[math.floor(1024 * float(c)) + 100000 for c in v] for v in values]
    n, dims = len(x), len(x[0])
    sums = [sum(v[d] for v in x) for d in range(dims)]
    apart = np.array([[n * c - s for c, s in zip(v, sums)] for v in x], float) / n
    cov = apart.T @ apart / n
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1], q[:, ::-1]
    white = apart @ q[:, :k] / np.sqrt(e[:k])
    rows = {}
    for r in got:
        rows.setdefault(r.vec_id, {})[r.component] = r
    assert len(got) == n * min(k, dims) and rows.keys() == set(ids)
    sign = {}
    for i, (vec_id, v) in enumerate(zip(ids, x)):
        exact = sum((n * c - s) ** 2 for c, s in zip(v, sums))
        for j in range(min(k, dims)):
            r = rows[vec_id][j + 1]
            sign.setdefault(j, 1 if r.whitened * white[i, j] >= 0 else -1)
            assert r.n == n and r.deviation == exact
            assert abs(r.whitened - sign[j] * white[i, j]) < 1e-8
            assert abs(r.explained - e[j] / e.sum()) < 1e-12
            assert r.identity_error < 1e-9


def test_query(spark, tmp_path):
    values = vectors(1, 300, 12)
    nan, inf = float("nan"), float("inf")
    rows = [(i, v.tolist(), 1, "x", "y", 2) for i, v in enumerate(values)]
    bad = [None, [None] * 12, [1.0] * 11 + [None], [nan] * 12, [inf] + [0.0] * 11, [0.0] * 11 + [-inf]]
    got = table(spark, tmp_path, rows + [(1000 + i, v, None, None, None, None) for i, v in enumerate(bad)])
    assert got.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    check(got.collect(), range(300), values)


def test_merges_in_a_tree(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    values = vectors(2, 200, 5)
    check(table(spark, tmp_path, [(i, v.tolist(), 1, "x", "y", 2) for i, v in enumerate(values)]).collect(), range(200), values)


def test_repeated_rows_and_null_ids(spark, tmp_path):
    values = vectors(3, 40, 9)
    rows = [(None if i < 3 else i, v.tolist(), 1, None, None, None) for i, v in enumerate(values)]
    got = table(spark, tmp_path, rows + [rows[9]]).collect()
    assert len(got) == 41 * 8 and {r.n for r in got} == {41}
    assert sum(r.vec_id is None for r in got) == 24 and sum(r.vec_id == 9 for r in got) == 16


def test_without_variance_or_rows(spark, tmp_path):
    same = table(spark, tmp_path / "same", [(i, [0.5, 0.25], 1, None, None, None) for i in range(4)]).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same] == [(1 + i % 2, 4, 0, 0.0, 0.0, 1.0) for i in range(8)]
    assert table(spark, tmp_path / "none", [(1, None, 1, None, None, None)]).collect() == []


def test_several_lengths(spark, tmp_path):
    with pytest.raises(Exception, match="several lengths"):
        table(spark, tmp_path, [(1, [1.0], 1, None, None, None), (2, [1.0, 2.0], 1, None, None, None)]).collect()


def test_symmetric_qr():
    rng = random.Random(4)
    for size in [*range(0, 12), 40, 64]:
        for kind in range(4):
            a = np.array([[rng.gauss(0, 1) for _ in range(size)] for _ in range(size)]).reshape(size, size)
            a = a + a.T
            if kind == 1:
                a = np.diag(np.arange(size, dtype=float) // 2)
            if kind == 2 and size:
                a = np.outer(a[0], a[0])
            if kind == 3:
                a = a * 1e8 + 1e6
            values, q = whitening.symmetric_qr(a)
            scale = max(1.0, np.abs(a).max(initial=0))
            assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-12 * scale * max(size, 1))
            assert np.allclose(q.T @ q, np.eye(size), atol=1e-12) and np.allclose(q * values @ q.T, a, atol=1e-12 * scale * max(size, 1))


def test_stream_and_merge_agree():
    x = vectors(5, 90, 6).astype(np.int64) * 100
    parts = []
    for own in (x[:1], x[1:40], x[40:]):
        m = whitening.Moments.none(6, True)
        m.add(own)
        parts.append(m)
    whole = parts[0].merged(parts[1]).merged(parts[2])
    assert whole.n == 90 and (whole.sums == x.sum(axis=0)).all()
    assert np.allclose(whole.products / 90, np.cov(x.T, bias=True))

"""Nearest neighbours and whitening against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import neighbours, whitening

NAN, INF = float("nan"), float("inf")
KIND = "vec_id long, embedding array<float>"


def table(spark, rows, kind=KIND):
    """With columns that are named like the operators' own."""
    return spark.createDataFrame(rows, kind).withColumns({c: F.lit("x") for c in ("v", "h1", "q", "members", "keys", "score", "rank", "id", "x", "w", "at", "component", "n")}).repartition(3)


def exact(rows, step=20, k=20):
    """{query_id: [(vec_id, score)]}: rows are (id, vector) pairs that take part."""
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float32).astype(np.float64)
    out = {}
    for i, q in enumerate(ids):
        if q % step == 0:
            s = v @ v[i]
            out[int(q)] = [(int(ids[j]), float(s[j])) for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def recall(got, want):
    """Of the true neighbours, the share found; scores that are given are those of the vectors."""
    assert set(got) == set(want)
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    return hit / sum(map(len, want.values()))


def clustered(rng, n, d):
    centres = rng.standard_normal((20, d))
    return centres[rng.integers(0, 20, n)] + 0.3 * rng.standard_normal((n, d))


@pytest.mark.parametrize("case", ["unit", "clustered", "lengths"])
def test_recall(spark, case):
    rng = np.random.default_rng(3)
    v = {"unit": rng.standard_normal((3000, 64)), "clustered": clustered(rng, 3000, 16), "lengths": rng.standard_normal((3000, 24)) * rng.lognormal(0, 1, (3000, 1))}[case]
    if case == "unit":
        v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    df = table(spark, rows)
    got, want = found(neighbours.nearest(df, neighbours.every(df, 20))), exact(rows)
    assert recall(got, want) >= 0.9
    scores = v.astype(np.float32).astype(np.float64)
    for q, near in got.items():
        assert len(near) == 20 and all(abs(s - scores[q] @ scores[i]) < 1e-9 for i, s in near)
        assert near == sorted(near, key=lambda x: (-x[1], x[0]))


def test_copies_ties_and_rows_that_take_no_part(spark):
    """A third of the rows is one vector; the neighbours are few enough to be found whole."""
    rng = np.random.default_rng(4)
    hot, near = rng.standard_normal(8), rng.standard_normal(8)
    rows = [(i, (hot if i % 3 == 0 else near if i % 3 == 1 else rng.standard_normal(8)).tolist()) for i in range(600)]
    odd = [(None, [1.0] * 8), (1000, None), (1020, []), (1040, [0.0] * 8), (1060, [NAN] + [1.0] * 7), (1080, [INF] + [1.0] * 7), (1100, [None] + [1.0] * 7), (1120, [1.0] * 9), (1140, [-0.0] * 8)]
    df = table(spark, [*rows, *rows[:50], *odd])
    got, want = found(neighbours.nearest(df, neighbours.every(df, 20))), exact(rows)
    assert set(got) == set(want)
    for q in want:
        if q % 3 < 2:  # copies of its own are its nearest, the smallest ids first
            assert [i for i, _ in got[q]] == [i for i in range(q % 3, 600, 3) if i != q][:20]
        assert all(i != q for i, _ in got[q])
    assert recall(got, want) >= 0.9


def test_few_rows_and_none(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (20, [-1.0, 0.5])]
    few = table(spark, rows)
    assert found(neighbours.nearest(few, neighbours.every(few, 20))) == exact(rows)
    one = few.filter("vec_id = 0")
    assert neighbours.nearest(one, one).count() == 0
    assert neighbours.nearest(few.filter("false"), few.filter("false")).count() == 0
    assert neighbours.nearest(few, few.filter("false")).count() == 0
    twice = table(spark, [*rows, (0, [2.0, 0.5]), (20, [7.0, 7.0])])  # of an id's vectors the first in order counts
    assert found(neighbours.nearest(twice, neighbours.every(twice, 20))) == exact(rows)


def test_more_blocks_than_one(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 7)
    rng = np.random.default_rng(5)
    rows = [(i, x.tolist()) for i, x in enumerate(clustered(rng, 700, 12))]
    df = table(spark, rows)
    assert recall(found(neighbours.nearest(df, neighbours.every(df, 20))), exact(rows)) >= 0.9


def test_probing_order():
    sets = neighbours.probing_order(3, 100)
    assert sets[0] == () and sets[1] == (0,) and len(sets) == 27 == len(set(sets))  # 3 choices a function


def whitened(spark, vectors, **more):
    return whitening.whiten(table(spark, list(enumerate(vectors)), **more)).orderBy("vec_id", "component").collect()


@pytest.mark.parametrize("d", [3, 64, 128])
def test_whitening(spark, d):
    rng = np.random.default_rng(d)
    v = (rng.standard_normal((400, d)) @ rng.standard_normal((d, d))).astype(np.float32)
    v[100:233] = v[0]  # copies count once in the fit
    rows = whitened(spark, v.tolist())
    x = np.floor(256 * v.astype(np.float64)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = fit - s / n
    e, axes = np.linalg.eigh(c.T @ c / n)
    e, axes = e[::-1], axes[:, ::-1]
    k = min(4, d)
    want = (x - s / n) @ axes[:, :k] / np.sqrt(e[:k])
    got = np.array([r.whitened for r in rows]).reshape(400, k)
    assert np.abs(got * np.sign((got * want).sum(axis=0)) - want).max() < 1e-8
    assert [r.component for r in rows[:k]] == list(range(1, k + 1)) and {r.n for r in rows} == {n}
    assert [r.deviation for r in rows[::k]] == [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True)) for row in x]
    assert all(abs(r.explained / (e[j] / e.sum()) - 1) < 1e-9 for j, r in enumerate(rows[:k]))
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9


def test_whitening_of_odd_rows(spark):
    base = [[1.0, 2.0, 3.0], [2.0, 1.0, 0.5], [-1.0, 0.0, 4.0], [0.0, 0.0, 0.0], [2.0, 1.0, 0.5]]
    odd = [None, [], [NAN, 0.0, 0.0], [INF, 0.0, 0.0], [None, 0.0, 0.0], [1.0, 2.0]]
    rows = whitened(spark, [*base, *odd])
    assert {r.vec_id for r in rows} == set(range(5)) and {r.n for r in rows} == {4}
    assert [r.whitened for r in rows if r.vec_id == 1] == [r.whitened for r in rows if r.vec_id == 4]
    df = table(spark, list(enumerate(base)))
    assert whitening.whiten(df.union(df)).count() == 2 * whitening.whiten(df).count()  # repeated rows give their rows
    assert whitening.whiten(df.filter("false")).count() == 0
    assert whitening.whiten(df.filter("vec_id = 0")).count() == 0
    flat = whitened(spark, [[0.0, 1.0], [0.0, 2.0], [0.0, 4.0]])  # no variance but in one dimension
    assert {r.component for r in flat} == {1} and abs(flat[0].explained - 1) < 1e-12
    assert whitening.whiten(table(spark, [(None, [1.0, 2.0]), (1, [3.0, 4.0])])).filter("vec_id IS NULL").count() == 1


def test_deviations_beyond_64_bits():
    x = np.array([[2**40, -(2**40)], [1, 2]])
    d = whitening._deviations(x, 10**6, np.array([5, 7]))
    assert d.dtype == object and d[0][0] == 10**6 * 2**40 - 5

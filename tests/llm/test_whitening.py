"""Operator 11 against numpy over all rows, and its defined edge cases."""

import numpy as np
import pytest

from quillon.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, x string, n int"


def frame(spark, vectors, schema=SCHEMA):
    return spark.createDataFrame([(i, v, "x", 3) for i, v in vectors], schema)


def expected(c):
    """n, sums, whitened values and explained shares of the rows ``c``, with exact integers before centring."""
    x = np.floor(256 * np.asarray(c, dtype=np.float64)).astype(np.int64)
    fit = np.unique(x, axis=0)
    centre = lambda v: (v.astype(object) * len(fit) - fit.astype(object).sum(axis=0)).astype(np.float64) / len(fit)
    e, u = np.linalg.eigh(centre(fit).T @ centre(fit) / len(fit))
    e, u = e[::-1], u[:, ::-1]
    exact = ((x.astype(object) * len(fit) - fit.astype(object).sum(axis=0)) ** 2).sum(axis=1)
    return len(fit), exact, centre(x) @ u[:, :4] / np.sqrt(e[:4]), e[:4] / e.sum()


def compare(got, c, tolerance):
    n, exact, y, share = expected(c)
    got = sorted(got, key=lambda r: (r.component, r.vec_id))
    k = y.shape[1]
    assert len(got) == k * len(c) and {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-8
    for j in range(k):
        rows = got[j * len(c) : (j + 1) * len(c)]
        mine = np.array([r.whitened for r in rows])
        assert [int(r.deviation) for r in rows] == list(exact) and np.allclose([r.explained for r in rows], share[j], rtol=1e-9)
        assert min(np.abs(mine - y[:, j]).max(), np.abs(mine + y[:, j]).max()) < tolerance


@pytest.mark.parametrize("offset", [0.0, 40_000.0])
def test_against_numpy(spark, offset):
    """Also where a common offset is far larger than the spread, and where one vector is a third of the rows."""
    rng = np.random.default_rng(4)
    c = (rng.standard_normal((300, 12)) @ rng.standard_normal((12, 12)) * np.linspace(1, 4, 12) + offset).astype(np.float32)
    c[200:] = c[7]
    got = whitening.whiten(frame(spark, [(i, v.tolist()) for i, v in enumerate(c)]).repartition(9), spark).collect()
    compare(got, c, 1e-7)


def test_merging_is_the_same_in_any_tree():
    rng = np.random.default_rng(5)
    x = rng.integers(-(10**6), 10**6, (500, 6)) + 10**12
    whole = whitening.moments(x)
    parts = [whitening.moments(p) for p in np.array_split(x, 17)]
    left, right = parts[0], parts[-1]
    for p in parts[1:]:
        left = whitening.merge(left, p)
    for p in parts[-2::-1]:
        right = whitening.merge(p, right)
    for m in (left, right):
        assert m.n == 500 and list(m.total) == list(whole.total) and np.allclose(m.scatter, whole.scatter, rtol=1e-12)
    assert list(whole.total) == [sum(map(int, col)) for col in x.T]


def test_unsound_vectors_copies_and_null_ids(spark):
    rng = np.random.default_rng(6)
    good = rng.standard_normal((40, 5)).astype(np.float32).round(2)
    rows = [(i, v.tolist()) for i, v in enumerate(good)] + [(3, good[3].tolist()), (None, good[4].tolist())]
    rows += [(100, None), (101, []), (102, [1.0, None, 0.0, 0.0, 0.0]), (103, [float("nan")] * 5), (104, [float("inf")] * 5), (105, [-0.0] * 5)]
    got = whitening.whiten(frame(spark, rows), spark).collect()
    ids = {r.vec_id for r in got}
    assert ids == {*range(40), None, 105} and len(got) == 4 * 43
    one = {r.component: r.whitened for r in got if r.vec_id == 4}
    assert one == {r.component: r.whitened for r in got if r.vec_id is None}
    assert {r.n for r in got} == {len(np.unique(np.floor(256 * np.vstack([good, np.zeros((1, 5))]).astype(np.float64)), axis=0))}


def test_lengths_and_components_without_variance(spark):
    rows = [(i, [float(i), 2.0, 2.0 * i]) for i in range(6)] + [(10 + i, [float(i * i)]) for i in range(4)] + [(20, [1.0, 2.0])]
    got = {(r.vec_id, r.component): r for r in whitening.whiten(frame(spark, rows), spark).collect()}
    assert {k for k in got if k[0] < 10} == {(i, k) for i in range(6) for k in (1, 2, 3)}
    assert all(got[i, 1].whitened is not None and got[i, 2].whitened is None and got[i, 3].whitened is None and got[i, 2].explained == 0 for i in range(6))
    assert abs(got[0, 1].explained - 1) < 1e-12 and got[0, 1].identity_error < 1e-9
    assert {got[10 + i, 1].n for i in range(4)} == {4} and (10, 2) not in got
    lone = got[20, 1]
    assert (lone.n, lone.deviation, lone.whitened, lone.explained, lone.identity_error) == (1, 0, None, 0.0, 0.0) and (20, 2) in got


def test_numbers_beyond_a_long(spark):
    """Integers at the end of their range, and deviations that are exact beyond 63 bits."""
    rows = [(0, [1e30, 3e9]), (1, [-1e30, -3e9]), (2, [5.0, 1.0]), (3, [7e7, -3e9])]
    got = {r.vec_id: r for r in whitening.whiten(spark.createDataFrame([(i, v, "", 0) for i, v in rows], "vec_id long, embedding array<double>, x string, n int"), spark).collect() if r.component == 1}
    clip = lambda c: max(-(2**63), min(2**63 - 1, int(np.floor(256 * c))))
    x = [[clip(c) for c in v] for _, v in rows]
    want = [sum((4 * a - sum(col)) ** 2 for a, col in zip(v, zip(*x, strict=True), strict=True)) for v in x]
    assert [got[i].deviation is None if w >= 10**38 else int(got[i].deviation) == w for i, w in enumerate(want)] == [True] * 4
    assert got[0].identity_error < 1e-6


def test_empty_table(spark):
    got = whitening.whiten(frame(spark, []), spark)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and got.collect() == []

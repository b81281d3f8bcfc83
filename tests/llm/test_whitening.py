"""Operator 11 against exact fractions and against what whitening means."""

import math
from fractions import Fraction

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from mizan.llm import whitening
from mizan.llm.common import read
from tests.compare import SF_DIR


@given(st.lists(st.tuples(*[st.floats(-1e6, 1e6)] * 3), min_size=1, max_size=40))
def test_products_are_exact_to_double_double(rows):
    x = np.array(rows)
    got = whitening.products(x, np.zeros_like(x))
    for i in range(3):
        for j in range(i, 3):
            want = sum(Fraction(a[i]) * Fraction(a[j]) for a in rows)
            size = sum(abs(Fraction(a[i]) * Fraction(a[j])) for a in rows)
            assert abs(Fraction(float(got[i][0][j - i])) + Fraction(float(got[i][1][j - i])) - want) <= size / 2**95 + Fraction(1, 2**1060)


def test_eigen_meets_its_definition():
    g = np.random.default_rng(3)
    q, _ = np.linalg.qr(g.normal(size=(40, 40)))
    want = np.concatenate([np.full(3, 5.0), 10.0 ** -np.arange(1, 13), np.linspace(1, 2, 25)])
    v = (q * want) @ q.T
    e, x = whitening.eigen(((v + v.T) / 2).astype(np.longdouble))
    assert np.abs(np.sort(want)[::-1] - e).max() < 1e-14 and np.abs(x.T @ x - np.eye(40)).max() < 1e-15 * 4
    assert np.abs(v @ x - x * e).max() < 1e-14


def exact(vectors):
    """(x, n, S, covariance in fractions) of usable vectors."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    n, dims = len(x), range(len(x[0]))
    s = [sum(r[i] for r in x) for i in dims]
    v = [[sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in x) / Fraction(n**3) for j in dims] for i in dims]
    return x, n, s, v


def test_given_table_against_fractions(spark):
    rows = read(spark, SF_DIR, "embeddings")
    got = whitening.fit(rows).transform(rows).collect()
    data = [(r.vec_id, r.embedding) for r in rows.collect()]
    x, n, s, v = exact([e for _, e in data])
    a = np.array([[float(c) for c in r] for r in v])
    e = np.linalg.eigvalsh(a)[::-1]
    ids = sorted({r.vec_id for r in got})
    assert ids == sorted(i for i, _ in data) and len(got) == 32 * n and {r.n for r in got} == {n}
    w = np.zeros((n, 32))
    place = {i: k for k, (i, _) in enumerate(data)}
    for r in got:
        w[place[r.vec_id], r.component - 1] = r.whitened
        assert math.isclose(r.explained, e[r.component - 1] / np.trace(a), rel_tol=1e-12)
    for k, r in enumerate(x):
        want = sum((n * c - t) ** 2 for c, t in zip(r, s, strict=True))
        assert {g.deviation for g in got if g.vec_id == data[k][0]} == {want} if k < 20 else True
    c = np.array([[float(Fraction(n * q - t, n)) for q, t in zip(r, s, strict=True)] for r in x])
    vectors = (c.T @ w) / n / np.sqrt(e[:32])  # a component, from its projections
    assert np.abs(a @ vectors - vectors * e[:32]).max() < 1e-9 * e[0]
    assert np.abs(w.T @ w / n - np.eye(32)).max() < 1e-10
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-10


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, None), (3, [None, 1.0]), (4, [nan, 0.0]), (5, [inf, 0.0]), (6, []), (7, [1.0, 2.0, 3.0]), (8, [-1.0, 7.0]), (8, [-1.0, 7.0]), (None, [0.5, 0.25]), (9, [1e30, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 x", "2 n", "3 component", "4 whitened").repartition(4)
    got = whitening.fit(df).transform(df).collect()
    x, n, s, _ = exact([[1.0, 2.0], [-1.0, 7.0], [-1.0, 7.0], [0.5, 0.25]])
    want = sorted(sum((n * c - t) ** 2 for c, t in zip(r, s, strict=True)) for r in x)
    assert n == 4 and sorted(r.deviation for r in got if r.component == 1) == want
    assert sorted(str(r.vec_id) for r in got) == ["1", "1", "8", "8", "8", "8", "None", "None"]
    assert got[0].identity_error < 1e-12


def test_without_variance(spark):
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    for df in (same, none):
        out = whitening.fit(df).transform(df)
        assert out.collect() == [] and len(out.columns) == 7


def test_one_dimension_follows_another(spark):
    g = np.random.default_rng(1).normal(size=(200, 2))
    df = spark.createDataFrame([(i, [float(a), float(a), float(b)]) for i, (a, b) in enumerate(g)], "vec_id long, embedding array<double>")
    got = whitening.fit(df)
    assert len(got.values) == 2 and got.identity_error < 1e-12


def test_deviations_beyond_a_long():
    w = whitening.Whitener(whitening.Center(3, [10**13, 5]), np.ones(1), np.ones((2, 1)), 1.0)
    assert w.deviations(np.array([[10**12, 2], [3_333_333_333_333, 2]])) == [None, 2]

"""The fit by blocks against one dense system, and the truth that a synthetic market was made from."""

import numpy as np
import pytest

from mizan.operators import valuation as V

YEAR = 1405


def made(n, rng, noise=0.0, models=4):
    rows = []
    for i in range(n):
        m = int(rng.integers(models))
        age = int(rng.integers(0, 15))
        km = int(rng.integers(0, 300_000))
        auto, body = bool(rng.integers(2)), ["intact", "minor_scratches", "partly_repainted", "repainted_around"][int(rng.integers(4))]
        trim = int(m * 10 + rng.integers(3)) if rng.random() < 0.7 else None
        ln = 20 + 0.3 * m - (0.05 + 0.01 * m) * age - 0.08 * (km - 20_000 * max(age, 0.5)) / 100_000 + 0.1 * auto - 0.06 * (body == "partly_repainted") - 0.1 * (body == "repainted_around") + (0 if trim is None else 0.02 * (trim % 10))
        rows.append((i, m, trim, YEAR - age, km, "automatic" if auto else "manual", "petrol", body, None, None, ["white", "red", None][int(rng.integers(3))], int(rng.integers(0, 30)), int(np.exp(ln + noise * rng.normal()))))
    return rows


SCHEMA = "listing_id long, model_id long, trim_id long, model_year int, mileage_km int, gearbox string, fuel string, body_condition string, front_chassis string, rear_chassis string, colour_family string, days_before int, asking_price long"


def dense(rows, x, trims):
    """beta, leave-one-out logarithms: the same ridge as one dense system."""
    models = sorted({r[1] for r in rows})
    at = {("m", m): V.N + 2 * i for i, m in enumerate(models)} | {("t", t): V.N + 2 * len(models) + i for i, t in enumerate(trims)}
    size = V.N + 2 * len(models) + len(trims)
    a = np.zeros((len(rows), size))
    a[:, : V.N] = x
    for k, r in enumerate(rows):
        a[k, at["m", r[1]]] = 1
        a[k, at["m", r[1]] + 1] = x[k, 0]
        if ("t", r[2]) in at:
            a[k, at["t", r[2]]] = 1
    penalty, target = np.zeros(size), np.zeros(size)
    penalty[: V.N], target[: V.N] = V.PENALTY, V.TARGET
    for m in models:
        penalty[at["m", m]], penalty[at["m", m] + 1] = V.LEVEL_PENALTY, V.STRENGTH * V.SLOPE_SCALE**2
    for t in trims:
        penalty[at["t", t]] = V.STRENGTH
    y = np.log([r[-1] for r in rows])
    g = a.T @ a + np.diag(penalty)
    beta = np.linalg.solve(g, a.T @ y + penalty * target)
    h = np.einsum("ij,jk,ik->i", a, np.linalg.inv(g), a)
    return beta, y - (y - a @ beta) / (1 - h)


@pytest.fixture
def free():
    """Bounds so wide that none holds."""
    low, high = V.LOW.copy(), V.HIGH.copy()
    V.LOW[:], V.HIGH[:] = -9, 9
    yield
    V.LOW[:], V.HIGH[:] = low, high


def test_blocks_are_the_dense_system(spark, free):
    rows = made(260, np.random.default_rng(1), 0.1)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).cache()
    x = np.array([[float(v) for v in r] for r in df.orderBy("listing_id").select(*V.features(YEAR).values()).collect()])
    counts = {}
    for r in rows:
        counts[r[2]] = counts.get(r[2], 0) + 1
    beta, loo = dense(rows, x, [t for t, n in counts.items() if t is not None and n >= V.LEAST_TRIM])
    fit = V.ridge(df, YEAR)
    assert np.allclose(list(fit.shared.values()), beta[: V.N], atol=1e-6)
    got = {r["listing_id"]: r["ln_left_out"] for r in V.left_out(fit, df, YEAR).collect()}
    assert np.allclose([got[r[0]] for r in rows], loo, atol=1e-6)


def test_market_is_recovered_within_bounds(spark):
    df = spark.createDataFrame(made(400, np.random.default_rng(2), 0.03), SCHEMA)
    fit = V.ridge(df, YEAR)
    assert all(lo - 1e-9 <= b <= hi + 1e-9 for b, lo, hi in zip(fit.shared.values(), V.LOW, V.HIGH, strict=True))
    assert abs(fit.shared["mileage_deviation"] + 0.08) < 0.02 and abs(fit.shared["gearbox_automatic"] - 0.1) < 0.02
    assert all(V.LOW[0] - 1e-9 <= r["slope"] <= V.HIGH[0] + 1e-9 for r in fit.models.collect())
    done = V.valuation(df, YEAR)
    parts = done.segments.collect()
    assert len(parts) == 4 and all(r["rates"] and r["error_pct"] < 8 for r in parts)


def test_bounds_hold_and_outliers_go(spark):
    rows = made(200, np.random.default_rng(3), 0.02)
    rows = [(*r[:-1], int(r[-1] * (1.5 if r[5] == "automatic" else 1))) for r in rows]  # automatics far over the bound
    rows[7] = (*rows[7][:-1], rows[7][-1] * 10)
    done = V.valuation(spark.createDataFrame(rows, SCHEMA), YEAR)
    assert abs(done.fit.shared["gearbox_automatic"] - V.HIGH[V.TERMS.index("gearbox_automatic")]) < 1e-9
    assert {r["listing_id"] for r in done.comparables.filter("is_outlier").collect()} >= {7}


def test_thin_models_are_not_rated(spark):
    rows = [r for r in made(200, np.random.default_rng(4), 0.02) if r[1] or r[0] < 20]
    parts = {r["model_id"]: r for r in V.valuation(spark.createDataFrame(rows, SCHEMA), YEAR).segments.collect()}
    assert all(r["rates"] == (r["comparables"] >= 8) for r in parts.values()) and not parts[0]["rates"]


def test_random_split_scores_the_rest(spark):
    rows = spark.createDataFrame(made(500, np.random.default_rng(6), 0.02), SCHEMA)
    got = {r["model_id"]: r for r in V.random_split(rows, YEAR).collect()}
    picked, state = 0, 51
    for _ in range(500):
        state = (state * 1664525 + 1013904223) % 2**32
        picked += state / 2**32 < 0.8
    assert got[None]["tested"] == 500 - picked and got[None]["mdape"] < 6 and sum(r["tested"] for k, r in got.items() if k is not None) == 500 - picked

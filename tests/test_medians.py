"""Exact medians of groups of any size against the native aggregate, and that no group passes through one task."""

import random

import pytest
from pyspark.sql import functions as F

from mizan.operators import document as D
from mizan.operators import market as M
from mizan.operators import valuation as V


@pytest.mark.parametrize("keys", [["k"], []])
def test_equal_to_the_native_median(spark, keys, monkeypatch):
    rng = random.Random(3)
    rows = [(k, v) for k, n in (("a", 1), ("b", 2), ("c", 501), (None, 1_000), ("ties", 300)) for v in [rng.gauss(0, 9) if k != "ties" else float(i % 3) for i in range(n)]] + [("none", None), ("c", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    want = sorted(map(str, df.groupBy(*keys).agg(F.percentile("v", 0.5)).filter("`percentile(v, 0.5, 1)` is not null").collect()))
    got = lambda: sorted(str(r).replace("m=", "percentile(v, 0.5, 1)=") for r in M.exact_medians(df, keys, "v", "m").collect())
    assert got() == want
    # marks that are far off cost work, not rightness
    sketch = F.percentile_approx
    for off in ([0.0, 0.001], [0.9, 1.0]):
        monkeypatch.setattr(F, "percentile_approx", lambda c, p, n, off=off: sketch(c, off, n))
        assert got() == want


def test_no_values(spark):
    empty = spark.createDataFrame([], "k string, v double")
    assert M.exact_medians(empty, ["k"], "v", "m").count() == 0 and M.exact_medians(empty, [], "v", "m").first()["m"] is None
    assert D.accuracy(spark.createDataFrame([], "k string, predicted long, price long"), "k").count() == 0


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_totals_hold_no_value_list(spark):
    rows = spark.createDataFrame([("a", 90, 100), ("b", 50, 100)], "k string, predicted long, price long")
    assert "percentile(" not in _plan(D.accuracy(rows, "k")).replace("percentile_approx(", "")
    some = spark.createDataFrame([(i, float(i)) for i in range(9)], "id long, r double")
    assert "percentile(" not in _plan(V.residual_outliers(some, F.col("r"))).replace("percentile_approx(", "")

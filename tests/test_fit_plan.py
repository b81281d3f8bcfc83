"""The fit and the random split move no rows by their ids; numbers are given to whole rows."""

import re

from mizan.operators import market as M
from mizan.operators import valuation as V
from tests.test_valuation import SCHEMA, YEAR, made

import numpy as np


def test_rows_are_not_joined_by_id(spark, monkeypatch):
    plans = []
    for module in (V, M):
        def seen(df, name="stored", put=module.stored if hasattr(module, "stored") else None):
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
            return put(df, name)

        monkeypatch.setattr(module, "stored", seen, raising=False)
    out = V.random_split(spark.createDataFrame(made(200, np.random.default_rng(6), 0.02), SCHEMA), YEAR)
    plans.append(out._jdf.queryExecution().optimizedPlan().toString())
    assert plans and not [p for p in plans if re.search(r"Join \w+, [^\n]*listing_id", p)]


def test_numbers_go_with_whole_rows(spark):
    rows = spark.range(1000).selectExpr("cast(id * 7919 % 1000 AS string) AS k", "id AS v").repartition(5)
    got = M.numbered(rows, "k", "v").collect()
    want = sorted(str(i) for i in range(1000))
    assert [r["k"] for r in sorted(got, key=lambda r: r["n"])] == want and [r["n"] for r in sorted(got, key=lambda r: r["n"])] == [*range(1, 1001)]
    assert all(int(r["k"]) == r["v"] * 7919 % 1000 for r in got)

"""Residuals are written once: the distances from their median are reckoned as they are read."""

import numpy as np

from mizan.operators import valuation as V


def test_rows_are_written_once(spark, monkeypatch):
    seen, put = [], V.stored
    monkeypatch.setattr(V, "stored", lambda df, name="stored": seen.append(out := put(df, name)) or out)
    rows = spark.createDataFrame([(i, float(i * i)) for i in range(50)], "id long, r double")
    out = V.residual_outliers(rows, rows.r, 2.0)
    assert [n for n in (x.count() for x in seen) if n > 1] == [50]
    off = np.abs(np.arange(50.0) ** 2 - np.median(np.arange(50.0) ** 2))
    assert {r["id"] for r in out.filter("is_far").collect()} == set(np.flatnonzero(off > 2 * V.MAD_SCALE * np.median(off)).tolist())

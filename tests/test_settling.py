"""Settling a sentence against counting one search after another."""

import itertools

import pytest
from pyspark.sql import functions as F

from mizan.functions import text as T
from mizan.operators.settling import settle, subset_counts

ROWS = [(1, "red car sunroof", "a"), (2, "red car", "a"), (3, "blue van 12", "a"), (4, "blue sunroof", "b"), (5, None, "a"), (6, "", "a"), (7, "green van sunroof 12", "a")]


def loop(count, groups):
    if count(()) == 0:
        return list(groups), []
    kept = list(range(len(groups)))
    while kept and count(tuple(kept)) == 0:
        best = max(range(len(kept)), key=lambda j: (count(tuple(kept[:j] + kept[j + 1 :])), j))
        kept.pop(best)
    return [groups[i] for i in kept], [g for i, g in enumerate(groups) if i not in kept]


@pytest.mark.parametrize("base", ["kind = 'a'", "kind = 'none'", "kind is null"])
@pytest.mark.parametrize("groups", [[], ["red"], ["red", "van"], ["blue car", "van", "sunroof"], ["zz", "sun"], ["12", "red", "green", "blue"], ["...", "zz"]])
def test_settled(spark, base, groups):
    df = spark.createDataFrame(ROWS, "id long, text string, kind string").selectExpr("*", "1 kept", "2 n", "3 failed")
    tokens = T.lexemes(F.col("text"))
    kind = {"kind = 'a'": "a"}.get(base)

    def count(kept):
        terms = [t for i in kept for t in T.plain_terms(groups[i])]
        return sum(k == kind and all(any(w == t if exact else w.startswith(t) for w in (x or "").split()) for t, exact in terms) for _, x, k in ROWS)

    got = settle(df, F.expr(base), tokens, groups)
    assert (got.kept, got.dropped) == loop(count, groups)
    every = {r["kept"]: r["n"] for r in subset_counts(df, F.expr(base), tokens, groups).collect()}
    for size in range(len(groups) + 1):
        for some in itertools.combinations(range(len(groups)), size):
            assert every[sum(1 << i for i in some)] == count(some)

"""What is left of a sentence: which groups of its unread words a search can keep and still find something."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mizan.functions import text as T

#: Groups of words that are searched for at most: they make 2 ** MOST_GROUPS counts.
MOST_GROUPS = 6


def subset_counts(rows: DataFrame, base: Column, tokens: Column, groups: list[str]) -> DataFrame:
    """(kept, n): for every set of groups, as bits, how many rows pass base and hold all words of the groups in it.

    One scan and one combining aggregate: rows are counted by the set of groups that they fail, 2 ** groups counts at
    most, and a set's number is the sum over what fails none of it. Words are met as plain_terms() has them; a group
    without words is met by every row. Null tokens meet nothing."""
    groups = groups[:MOST_GROUPS]
    met = [F.coalesce(T.matches(tokens, T.plain_terms(g)), F.lit(False)) for g in groups]
    failed = F.lit(0)
    for i, m in enumerate(met):
        failed = failed + F.when(m, 0).otherwise(1 << i)
    counts = rows.filter(F.coalesce(base, F.lit(False))).groupBy(failed.alias("failed")).agg(F.count("*").alias("n"))
    sets = rows.sparkSession.range(1 << len(groups)).select(F.col("id").cast("int").alias("kept"))
    each = F.filter(F.sequence(F.lit(0), F.lit((1 << len(groups)) - 1)), lambda k: k.bitwiseAND(F.col("failed")) == 0)
    found = counts.select(F.explode(each).alias("kept"), "n").groupBy("kept").agg(F.sum("n").alias("n"))
    return sets.join(found, "kept", "left").select("kept", F.coalesce("n", F.lit(0)).alias("n"))


@dataclass(frozen=True)
class Settled:
    """The groups kept and dropped, in the sentence's order, and how many rows the search then finds."""

    kept: list[str]
    dropped: list[str]
    found: int


def settle(rows: DataFrame, base: Column, tokens: Column, groups: list[str]) -> Settled:
    """Groups go one at a time until something is found: the one whose going leaves most rows, the later one of equals. If
    base alone finds nothing, or all groups find something, all stay. Only subset_counts() is collected."""
    groups = groups[:MOST_GROUPS]
    n = {r["kept"]: r["n"] for r in subset_counts(rows, base, tokens, groups).collect()}
    kept = (1 << len(groups)) - 1
    while n[0] and kept and not n[kept]:
        here = [i for i in range(len(groups)) if kept >> i & 1]
        kept ^= 1 << max(here, key=lambda i: (n[kept ^ 1 << i], i))
    stays = lambda bit: [g for i, g in enumerate(groups) if (kept >> i & 1) == bit]
    return Settled(stays(1), stays(0), n[kept])

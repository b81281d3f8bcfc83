"""Connected components of a graph of links, by DataFrame steps alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mizan.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """(id, root) for every id of links(a, b): root is the smallest id that links lead to.

    Alternating large-star and small-star steps (Kiveris and others, 2014): every step hangs neighbours onto the
    smallest id around, so stars form in a number of steps logarithmic in the longest path. The minimum is a combining
    aggregate and neighbours come back by a join, so no neighbourhood is ever gathered in one place.
    """
    edges = scratch.keep(
        links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi > lo").distinct(), f"{tag}-0"
    )
    before, n = None, 0
    while True:  # until a step changes nothing
        n += 1
        both = edges.union(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo"))).toDF("id", "near")
        least = both.groupBy("id").agg(F.min("near").alias("m")).select("id", F.least("id", "m").alias("m"))
        large = both.filter("near > id").join(least, "id").select(F.col("near").alias("hi"), F.col("m").alias("lo"))
        large = large.filter("hi > lo").distinct()
        up = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(up, "hi").select(F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("m").alias("lo"))
        sums = (F.count("*").alias("n"), F.sum("lo").alias("lo"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h"))
        edges, now = scratch.observed(small.filter("hi > lo").distinct(), f"{tag}-{n}", *sums)
        scratch.drop(f"{tag}-{n - 1}")
        if now == before:
            break
        before = now
    roots = edges.select(F.col("lo").alias("id")).distinct().withColumn("root", F.col("id"))
    return edges.select(F.col("hi").alias("id"), F.col("lo").alias("root")).union(roots)

"""Mixing sources to target weights: hierarchical budgets, seeded epochs, token prefixes (operator 7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mizan.llm.common import read
from mizan.llm.decontam import word_list

#: Fixed target weights of the registered query and the pipeline; what is not named weighs OTHER.
DOMAINS = {"d0": 50, "d1": 30, "d2": 20}
LANGUAGES = {"en": 50, "de": 20, "fr": 20, "es": 10}
OTHER = 5
#: Hex digits of the order's hash that make a bin; a leaf's prefix sum runs over 16 ** BIN_DIGITS bins.
BIN_DIGITS = 3


def weight_of(column: str, weights: dict[str, int], other: int) -> Column:
    """An integer weight for each value."""
    if not weights:
        return F.lit(other)
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return F.coalesce(table[F.col(column)], F.lit(other))


def pour(nodes: DataFrame, parent: list[str], key: str) -> DataFrame:
    """Shares of `budget` among the children of each parent: in proportion to `weight`, none above `cap`, what a full
    child leaves going to its siblings by weight. Adds alloc (whole tokens). A child of weight 0 has cap 0.

    Sorted by cap / weight, children fill up in that order, so the level at which the rest share is found by prefix sums
    instead of rounds.
    """
    w = Window.partitionBy(*parent, "budget").orderBy("ratio", key)
    before, whole = w.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*parent, "budget")
    some = nodes.withColumn("ratio", F.when(F.col("weight") > 0, F.col("cap").cast("double") / F.col("weight")).otherwise(0.0))
    some = some.withColumns({"cap0": F.coalesce(F.sum("cap").over(before), F.lit(0)), "weight0": F.coalesce(F.sum("weight").over(before), F.lit(0)), "weights": F.sum("weight").over(whole)})
    some = some.withColumn("full", F.col("cap0") + F.col("ratio") * (F.col("weights") - F.col("weight0")) <= F.col("budget"))
    some = some.withColumns({"cap1": F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(whole), "weight1": F.sum(F.when(F.col("full"), F.col("weight")).otherwise(0)).over(whole)})
    open_ = F.nullif(F.col("weights") - F.col("weight1"), F.lit(0))  # null where all are full
    share = F.floor((F.col("budget") - F.col("cap1")).cast("double") / open_ * F.col("weight"))
    some = some.withColumn("alloc", F.when(F.col("full"), F.col("cap")).otherwise(F.least(share, F.col("cap"))).cast("long"))
    return some.drop("ratio", "cap0", "weight0", "weights", "full", "cap1", "weight1")


def leaf_budgets(leaves: DataFrame, budget: Column, max_epochs: int, domains: dict, languages: dict, sources: dict, other: int) -> DataFrame:
    """leaves(domain, lang, source, supply) with target: the tokens to take from each.

    Weights go down the tree. A node can take what the leaves below it hold, max_epochs times over, so a leaf's shortage
    is made up by its sources' siblings, then, where their language is short as a whole, by other languages of the
    domain, then by other domains.
    """
    wanted = (weight_of("domain", domains, other) > 0) & (weight_of("lang", languages, other) > 0) & (weight_of("source", sources, 1) > 0)
    leaves = leaves.withColumn("cap", F.when(wanted, F.col("supply") * max_epochs).otherwise(0))
    total = leaves.agg(F.sum("supply").alias("all"), F.sum("cap").alias("most")).select(F.least(budget.cast("long"), F.col("most")).alias("budget"))
    top = leaves.groupBy("domain").agg(F.sum("cap").alias("cap")).withColumn("weight", weight_of("domain", domains, other)).crossJoin(F.broadcast(total))
    top = pour(top, [], "domain").select("domain", F.col("alloc").alias("budget"))
    mid = leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).withColumn("weight", weight_of("lang", languages, other)).join(top, "domain")
    mid = pour(mid, ["domain"], "lang").select("domain", "lang", F.col("alloc").alias("budget"))
    low = leaves.withColumn("weight", weight_of("source", sources, 1)).join(mid, ["domain", "lang"])
    return pour(low, ["domain", "lang"], "source").select("domain", "lang", "source", "supply", F.col("alloc").alias("target"))


def mix(docs: DataFrame, domain: Column, *, budget: Column | None = None, max_epochs: int = 2, seed: int = 42, domains: dict = DOMAINS, languages: dict = LANGUAGES, sources: dict | None = None, other: int = OTHER) -> DataFrame:
    """docs with domain, n_tokens, leaf_tokens, leaf_target and copies: how often a document is taken.

    budget: the tokens wanted, an expression that may use `all` (those there are); four fifths of all by default. A leaf that must give more than it
    holds is gone through in whole epochs first; in its last epoch it gives the longest prefix, in an order hashed from
    seed, epoch and doc_id, that its target still holds. Prefix sums run over hash bins, then within one bin, so a leaf
    with a third of all rows is summed by many tasks.

    Null lang, source or domain: the value ''. Null and empty texts: 0 tokens; they go with what comes before them in
    the order. Repeated or null doc_ids: one hash, so they stand together, ordered by text. Rows alike in all of these
    stand next to each other. A weight of 0 takes nothing. An empty table: no rows. Other
    columns are kept, whatever their names; the five named above are replaced.
    """
    budget = F.floor(F.col("all") * 8 / 10) if budget is None else budget
    made = ("domain", "n_tokens", "leaf_tokens", "leaf_target", "copies")
    # the table's own columns go by number, so none clashes with those made here
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select("*", domain.cast("string")).toDF(*own.values(), "domain").withColumns({"domain": F.coalesce("domain", F.lit("")), "n_tokens": F.size(word_list(F.col(own["text"]))).cast("long")})
    named = rows.withColumns({"lang": F.coalesce(own["lang"], F.lit("")), "source": F.coalesce(own["source"], F.lit("")), "hash": F.xxhash64(own["text"])})
    leaf = ["domain", "lang", "source"]
    leaves = named.groupBy(*leaf).agg(F.sum("n_tokens").alias("supply"))
    plan = leaf_budgets(leaves, budget, max_epochs, domains, languages, sources or {}, other)
    plan = plan.withColumn("epoch", F.when(F.col("supply") > 0, F.floor(F.col("target") / F.col("supply"))).otherwise(0).cast("int"))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col("epoch").cast("string"), F.lit(":"), F.coalesce(F.col(own["doc_id"]).cast("string"), F.lit(""))))
    keyed = named.join(plan, leaf).withColumn("key", key).withColumn("bin", F.substring("key", 1, BIN_DIGITS))
    # dealt by leaf and bin, so no task sums a whole leaf
    bins = keyed.select(*leaf, "bin", "n_tokens").repartition(*leaf, "bin").groupBy(*leaf, "bin").agg(F.sum("n_tokens").alias("sum"))
    bins = bins.withColumn("ahead", F.coalesce(F.sum("sum").over(Window.partitionBy(*leaf).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("sum")
    within = Window.partitionBy(*leaf, "bin").orderBy("key", "hash").rowsBetween(Window.unboundedPreceding, 0)
    summed = keyed.join(bins, [*leaf, "bin"]).withColumn("to", F.col("ahead") + F.sum("n_tokens").over(within))
    last = (F.col("to") <= F.col("target") - F.col("epoch") * F.col("supply")).cast("int")
    out = summed.withColumn("copies", F.when(F.col("target") > 0, F.col("epoch") + F.when(F.col("epoch") < max_epochs, last).otherwise(0)).otherwise(0).cast("int"))
    out = out.withColumnsRenamed({"supply": "leaf_tokens", "target": "leaf_target"})
    return out.select(*[F.col(x).alias(c) for c, x in own.items() if c not in made], *made)


def source_domain() -> Column:
    """The registered query's domains: sources dealt out by their number."""
    return F.concat(F.lit("d"), F.coalesce(F.expr("try_cast(regexp_extract(source, '([0-9]+)$', 1) as int) % 3"), F.lit(0)).cast("string"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mix(docs, source_domain()).select("doc_id", "domain", "lang", "source", "n_tokens", "leaf_tokens", "leaf_target", "copies")


def _pour_sql(source: str, parent: str, key: str) -> str:
    over = f"PARTITION BY {parent}budget"
    return f"""(SELECT * EXCLUDE (r, c0, w0, ws, f, c1, w1), CAST(CASE WHEN f THEN cap ELSE least(CAST(floor(CAST(budget - c1 AS DOUBLE) / (ws - w1) * weight) AS BIGINT), cap) END AS BIGINT) alloc FROM (
 SELECT *, sum(CASE WHEN f THEN cap ELSE 0 END) OVER ({over}) c1, sum(CASE WHEN f THEN weight ELSE 0 END) OVER ({over}) w1 FROM (
 SELECT *, c0 + r * (ws - w0) <= budget f FROM (
 SELECT *, coalesce(sum(cap) OVER ({over} ORDER BY r, {key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) c0, coalesce(sum(weight) OVER ({over} ORDER BY r, {key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) w0, sum(weight) OVER ({over}) ws FROM (
 SELECT *, CAST(cap AS DOUBLE) / weight r FROM {source})))))"""


def _case(column: str, weights: dict, other: int) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + f" ELSE {other} END"


OP7_SQL = rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(lang, '') l, coalesce(source, '') s, text, 'd' || coalesce(TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 3, 0) AS dom,
  len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) n FROM documents),
leaf AS (SELECT dom, l, s, CAST(sum(n) AS BIGINT) supply, CAST(sum(n) AS BIGINT) * 2 cap FROM d GROUP BY ALL),
tot AS (SELECT least(CAST(floor(sum(supply) * 8 / 10) AS BIGINT), CAST(sum(cap) AS BIGINT)) budget FROM leaf),
t0 AS (SELECT dom, CAST(sum(cap) AS BIGINT) cap, {_case('dom', DOMAINS, OTHER)} weight, any_value(budget) budget FROM leaf, tot GROUP BY dom),
t1 AS (SELECT dom, alloc budget FROM {_pour_sql('t0', '', 'dom')}),
m0 AS (SELECT dom, l, CAST(sum(cap) AS BIGINT) cap, {_case('l', LANGUAGES, OTHER)} weight, any_value(budget) budget FROM leaf JOIN t1 USING (dom) GROUP BY dom, l),
m1 AS (SELECT dom, l, alloc budget FROM {_pour_sql('m0', 'dom, ', 'l')}),
s0 AS (SELECT leaf.*, 1 weight, budget FROM leaf JOIN m1 USING (dom, l)),
plan AS (SELECT dom, l, s, supply, alloc target, CASE WHEN supply > 0 THEN alloc // supply ELSE 0 END epoch FROM {_pour_sql('s0', 'dom, l, ', 's')}),
k AS (SELECT *, md5('42:' || epoch || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) key FROM d JOIN plan USING (dom, l, s)),
c AS (SELECT *, sum(n) OVER (PARTITION BY dom, l, s ORDER BY key ROWS UNBOUNDED PRECEDING) upto FROM k)
SELECT doc_id, dom AS domain, lang, source, CAST(n AS BIGINT) AS n_tokens, supply AS leaf_tokens, target AS leaf_target,
 CAST(CASE WHEN target > 0 THEN epoch + CASE WHEN epoch < 2 AND upto <= target - epoch * supply THEN 1 ELSE 0 END ELSE 0 END AS INT) AS copies FROM c
"""

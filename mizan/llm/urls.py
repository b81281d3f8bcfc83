"""URL filters: host and path rules, then a path-template tree judged by labelled purity (operator 8)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mizan.llm.common import Scratch, read

#: Fixed rules of the registered query: (host, path, verdict).
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path): what stands after the first ://, up to / ? # or the end, A-Z lower-cased; then up to ? # or the end.
    Both are empty where the url is null or has no ://."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    whole = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(whole, pattern, 1), UPPER, LOWER), F.regexp_extract(whole, pattern, 2)


def ruled(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """struct(length, rule, verdict) of the longest rule that fits the host, or a domain above it, and the path's start."""
    fits = [
        F.when(
            ((host == h) | host.endswith("." + h)) & path.startswith(p),
            F.struct(F.lit(len(h + p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
        )
        for h, p, v in rules
    ]
    if not fits:
        return F.expr("cast(null as struct<length: int, rule: string, verdict: string>)")
    return F.array_max(F.filter(F.array(*fits), lambda x: x.isNotNull()))


def met(rows: DataFrame, sums: DataFrame, keys: list[str], total: int) -> DataFrame:
    """rows with the columns of sums, by keys that each row finds once; sums' __n says how many of the `total` rows each
    of its own meets. Those that meet a thousandth or more, so a thousand at most, are broadcast and their rows stay where
    they are; the others' are shuffled. Both are written tables, since each is read twice."""
    heavy = F.col("__n") * 1000 >= total
    hot, cold = F.broadcast(sums.filter(heavy).drop("__n")), sums.filter(~heavy).drop("__n")
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys))


def template_tree(urls: DataFrame, tmp: Scratch, many: int = 8, share: float = 0.2) -> tuple[DataFrame, int]:
    """urls(host, path, ...) and template: the path with variable segments as wildcards; and the number of rows.

    From the root down, a node's segments become one wildcard child if they are many and most are rare: more than `many`
    different ones, and at least `share` of the visits' number. Digits, for this, are one shape: a wildcard keeps the
    shape around them (`#.html`), else it is `*`. Below a node that no more than `many` rows pass, nothing can vary, so its
    rows keep the rest of their path and are done; the others go on, to whatever depth they have. Each level is counted by
    (host, node, segment), so a host with most of the rows is summed by many tasks, and written before the next.
    """
    rows = urls.withColumns({"__s": F.filter(F.split("path", "/"), lambda s: s != ""), "template": F.lit("")})
    rows, found = tmp.observed(rows, "level-0", F.count("*").alias("left"))
    total = left = found["left"]
    done, level = [rows.filter("false").drop("__s")], 0
    while left:
        here = rows.withColumn("__x", F.coalesce(F.get("__s", F.lit(level)), F.lit("")))  # empty: the path ends
        seen = here.groupBy("host", "template", "__x").count()
        deeper = F.coalesce(F.sum(F.when(F.col("__x") != "", F.col("count"))), F.lit(0))
        kinds = F.count_if(F.col("__x") != "")
        node = seen.groupBy("host", "template").agg(F.sum("count").alias("__n"), ((kinds > many) & (kinds >= share * deeper)).alias("__varies"), (deeper > many).alias("__busy"))
        both = met(here, tmp.keep(node, f"node-{level}"), ["host", "template"], left)
        shape = F.regexp_replace("__x", "[0-9]+", "#")
        step = F.when(~F.col("__varies"), F.col("__x")).when(shape.contains("#"), shape).otherwise(F.lit("*"))
        tail = F.concat(F.lit("/"), F.array_join(F.slice("__s", F.lit(level + 1), F.size("__s")), "/"))
        grown = F.when(F.col("__x") == "", F.lit("")).when(F.col("__busy"), F.concat(F.lit("/"), step)).otherwise(tail)
        out = both.withColumns({"template": F.concat("template", grown), "__on": F.col("__busy") & (F.col("__x") != "")})
        out, found = tmp.observed(out.select(*rows.columns, "__on"), f"level-{level + 1}", F.count_if("__on").alias("left"))
        done.append(out.filter("not __on").drop("__s", "__on"))
        rows, left, level = out.filter("__on").drop("__on"), found["left"], level + 1
    return reduce(DataFrame.unionByName, done), total


def merged_branches(templates: DataFrame, tmp: Scratch, total: int, z: float = 1.96) -> DataFrame:
    """templates(host, template, n, labelled, bad), `total` rows, with branch: siblings whose share of bad labels does not
    differ significantly from that of all siblings together share one branch, with a wildcard for the segment in which
    they differ; the others, and those without siblings, keep their own. A sibling without labels shows no difference.

    From the deepest segment up to the first, level by level, on the branches that the levels below made. Only templates of
    one host and one length are ever siblings, so the levels start at the greatest length that a host has twice."""
    segments = F.size(F.split("template", "/")) - 1
    deepest = templates.groupBy("host", segments.alias("size")).count().filter("count > 1").agg(F.max("size")).first()[0]
    now = templates.withColumn("branch", F.col("template"))
    for level in range(deepest or 0, 0, -1):
        rest = F.array_join(F.transform(F.split("branch", "/"), lambda x, i: F.when(i == level, F.lit("*")).otherwise(x)), "/")
        sums = now.groupBy("host", "branch").agg(F.count("*").alias("__n"), F.sum("labelled").alias("__labelled"), F.sum("bad").alias("__own"))
        sums, found = tmp.observed(sums.withColumn("__rest", rest), f"branch-{level}", F.count("*").alias("n"))
        pool = sums.groupBy("host", "__rest").agg(F.sum("__own").alias("__bad"), F.sum("__labelled").alias("__all"), F.count("*").alias("__n"))
        pool = tmp.keep(pool.withColumn("__kinds", F.col("__n")), f"pool-{level}")
        both = met(sums.withColumnRenamed("__n", "__met"), pool, ["host", "__rest"], found["n"])
        rate, labelled = (F.col("__bad") + 1) / (F.col("__all") + 2), F.greatest("__labelled", F.lit(1))
        alike = (F.col("__labelled") == 0) | (F.abs(F.col("__own") / labelled - rate) <= z * F.sqrt(rate * (1 - rate) / labelled))
        step = both.select("host", "branch", F.col("__met").alias("__n"), F.when((F.col("__kinds") > 1) & alike, F.col("__rest")).otherwise(F.col("branch")).alias("__new"))
        out = met(now, tmp.keep(step, f"step-{level}"), ["host", "branch"], total)
        now = tmp.keep(out.withColumn("branch", F.col("__new")).select(*templates.columns, "branch"), f"merged-{level}")
    return now


def judge(spark: SparkSession, pages: DataFrame, labels: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, *, weight: float = 4.0, reject: float = 0.5) -> DataFrame:
    """pages(page_id, url) with host, path, rule, verdict, template, branch, impurity; labels(page_id, bad) mark some.

    A rule decides where one fits (the longest). Elsewhere the template does: it is blocked if the share of bad labels in
    its branch, smoothed towards its host's share and that towards the share of all labels (`weight` labels' worth each),
    is over `reject`.
    Null urls and urls without :// have an empty host and path; no rule fits them; they are judged as one template. Null
    and repeated page_ids: each row is judged; a label holds for every row of its id; repeated labels: the worst. An
    empty table: no rows; without labels nothing is blocked but by rules. Other columns are not looked at.
    """
    host, path = parts(F.col("url"))
    marks = labels.filter("page_id is not null and bad is not null").groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path")).join(marks, "page_id", "left")
    tmp = Scratch(spark, "urls")
    tree, rows = template_tree(urls, tmp)
    sums = tree.groupBy("host", "template").agg(F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    sums, found = tmp.observed(sums, "sums", F.count("*").alias("n"), F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled"))
    branch = merged_branches(sums, tmp, found["n"])
    whole = (found["bad"] or 0) / max(found["labelled"] or 0, 1)
    pure = branch.groupBy("host", "branch").agg(F.count("*").alias("__t"), F.sum("bad").alias("bb"), F.sum("labelled").alias("bl"))
    pure, branches = tmp.observed(pure, "pure", F.count("*").alias("n"))
    by_host = pure.groupBy("host").agg(F.count("*").alias("__n"), ((F.sum("bb") + weight * whole) / (F.sum("bl") + weight)).alias("prior"))
    judged = met(pure, tmp.keep(by_host, "hosts"), ["host"], branches["n"])
    judged = judged.select("host", "branch", F.col("__t").alias("__n"), ((F.col("bb") + weight * F.col("prior")) / (F.col("bl") + weight)).alias("impurity"))
    known = met(branch.select("host", "template", "branch", "n"), tmp.keep(judged, "judged"), ["host", "branch"], found["n"])
    known = tmp.keep(known.withColumnRenamed("n", "__n"), "known")
    out = met(tree.drop("bad"), known, ["host", "template"], rows).withColumn("__r", ruled(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce("__r.verdict", F.when(F.col("impurity") > reject, F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", F.col("__r.rule").alias("rule"), verdict.alias("verdict"), "template", "branch", F.round("impurity", 9).alias("impurity"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of this corpus show the document whose id is the last number of their path; its labels are the page's: bad if
    of quality 0 or toxic."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    _, path = parts(F.col("url"))
    of = pages.select("page_id", F.regexp_extract(path, r"([0-9]+)[^0-9/]*/?$", 1).try_cast("long").alias("doc_id"))
    marks = read(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return judge(spark, pages, of.join(marks, "doc_id").select("page_id", "bad"))

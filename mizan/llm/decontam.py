"""Benchmark decontamination: size-partitioned MinHash containment search, verified on exact shingles (operator 9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mizan.llm.common import read

#: Sketch values and whole shingles of all items up to which they go to every task; more items take the shuffled path.
SMALL_BENCHMARK = 200_000


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def word_list(text: Column) -> Column:
    """Lower-cased words of a text; a null text has none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def runs(words: Column, width: Column, make) -> Column:
    """make(run) for every run of width words; no runs if there are fewer words."""
    return F.when(F.size(words) >= width, F.transform(F.sequence(F.lit(1), F.size(words) - width + 1), lambda i: make(F.slice(words, i, width)))).otherwise(F.expr("array()"))


def item_sketches(items: DataFrame, shingle: int, share: int) -> DataFrame:
    """(item_id, width, n, shingles, probe) of items with at least one word.

    Items are partitioned by size, sizes up to each power of two being one partition. An item of n shingles of which at
    least share % are in a document lacks at most (100 - share) % of n, so of its floor((100 - share) % of the
    partition's largest n) + 1 least hash values (its bottom-k MinHash sketch) one at least is in the document: the
    search misses nothing, however long the document.
    """
    words = items.select("item_id", word_list(F.col("text")).alias("w")).filter(F.size("w") > 0)
    width = F.least(F.size("w"), F.lit(shingle))
    sets = words.select("item_id", width.alias("width"), F.array_distinct(runs(F.col("w"), width, lambda r: F.array_join(r, " "))).alias("shingles"), runs(hashed(F.col("w")), width, F.xxhash64).alias("hashes"))
    hashes = F.array_sort(F.array_distinct(F.col("hashes")))
    most = F.pow(F.lit(2.0), F.ceil(F.log2(F.size("shingles").cast("double")))).cast("long")  # the partition's largest n
    k = F.floor(most * (100 - share) / 100).cast("int") + 1
    return sets.select("item_id", "width", F.size("shingles").alias("n"), "shingles", F.slice(hashes, F.lit(1), F.least(k, F.size("shingles"))).alias("probe"))


def hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def shingle_hashes(words: Column, widths: list[int]) -> Column:
    """A hash of every run of each width, made of its words' hashes."""
    every = lambda h: F.concat(*[runs(h, F.lit(n), F.xxhash64) for n in widths])
    return let(hashed(words), every) if widths else F.expr("array(0L)")


def with_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, *, shingle: int = 5, share: int = 80) -> DataFrame:
    """docs and leaks: array<struct<item_id, shared, n>> of the benchmark items of whose n distinct shingles (runs of
    `shingle` words; the whole item, if it is shorter) at least share % are in the document's text.

    One pass over the documents and no shuffle, if the benchmark is small (SMALL_BENCHMARK, counted first). Otherwise
    sketch values meet documents' shingles in a shuffled join, keyed by what is compared: texts and sets of shingles, by
    SHA-256. Either way ids name nothing, so rows may repeat or lack them.
    Null and empty texts, and items without words: no leaks. Repeated items: each is reported. An empty benchmark: no
    leaks. A null item_id is kept as null. docs keeps all its columns; a column named leaks is replaced.
    """
    items = item_sketches(benchmark.select("item_id", "text"), shingle, share)
    shape = items.agg(F.coalesce(F.sum(F.size("probe") + F.col("n")), F.lit(0)).alias("size"), F.collect_set("width").alias("widths")).first()
    widths, enough = sorted(shape["widths"]), lambda shared, n: shared * 100 >= n * share
    # the table's own columns go by number, so none clashes with those made here
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    named = lambda df: df.select(*[F.col(x).alias(c) for c, x in own.items() if c != "leaks"], "leaks")
    docs, text = docs.toDF(*own.values()), F.col(own["text"])
    nothing = F.expr("cast(array() as array<struct<item_id: bigint, shared: int, n: int>>)")

    def judged(words: Column, found: Column) -> Column:
        """Exact containment of the items found as candidates."""
        texts = lambda n: runs(words, F.lit(n), lambda r: F.array_join(r, " "))
        every = F.concat(*[texts(n) for n in widths])
        count = lambda s: F.transform(found, lambda it: F.struct(it["item_id"].cast("long").alias("item_id"), F.size(F.array_intersect(it["shingles"], s)).alias("shared"), it["n"].alias("n")))
        return let(every, lambda s: F.filter(count(s), lambda x: enough(x["shared"], x["n"])))

    if not widths:
        return named(docs.withColumn("leaks", nothing))
    if shape["size"] <= SMALL_BENCHMARK:
        one = items.agg(F.collect_list(F.struct("item_id", "n", "shingles", "probe")).alias("items")).withColumn("probe", F.expr("array_distinct(flatten(transform(items, x -> x.probe)))"))
        near = lambda h: F.filter("items", lambda it: F.arrays_overlap(it["probe"], h))
        leaks = lambda w: let(shingle_hashes(w, widths), lambda h: F.when(F.arrays_overlap(h, F.col("probe")), judged(w, near(h))).otherwise(nothing))
        return named(docs.crossJoin(F.broadcast(one)).withColumn("leaks", let(word_list(text), leaks)))
    # items with the same shingles are one set, documents with the same text one text; ids are joined back at the end
    sets = items.groupBy(F.sha2(F.array_join(F.array_sort("shingles"), "\n"), 256).alias("__set")).agg(F.first("n").alias("n"), F.first("shingles").alias("shingles"), F.first("probe").alias("probe"), F.collect_list(F.struct("item_id")).alias("ids"))
    keyed = docs.withColumn("__text", F.sha2(text, 256))
    mine = keyed.select("__text", F.explode(let(word_list(text), lambda w: F.array_distinct(shingle_hashes(w, widths)))).alias("h"))
    found = mine.join(sets.select(F.explode("probe").alias("h"), "__set"), "h").select("__text", "__set").distinct()
    texts = keyed.select("__text", text.alias("text")).join(found.select("__text").distinct(), "__text").dropDuplicates(["__text"])
    parts = texts.select("__text", F.explode(let(word_list(F.col("text")), lambda w: F.array_distinct(F.concat(*[runs(w, F.lit(n), lambda r: F.array_join(r, " ")) for n in widths])))).alias("s"))
    whole = sets.select("__set", "n", F.explode("shingles").alias("s")).join(found, "__set")
    shared = whole.join(parts, ["__text", "s"]).groupBy("__text", "__set", "n").agg(F.count("*").cast("int").alias("shared"))
    each = shared.filter(enough(F.col("shared"), F.col("n"))).join(sets.select("__set", F.explode("ids").alias("id")), "__set")
    leaks = each.groupBy("__text").agg(F.collect_list(F.struct(F.col("id.item_id").cast("long").alias("item_id"), "shared", F.col("n").cast("int").alias("n"))).alias("leaks"))
    return named(keyed.join(leaks, "__text", "left").withColumn("leaks", F.coalesce("leaks", nothing)))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) of every leak."""
    found = with_leaks(spark, read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    one = found.select("doc_id", F.explode("leaks").alias("x"))
    return one.select("doc_id", F.col("x.item_id").alias("item_id"), F.col("x.shared").cast("long").alias("n_shared"), F.col("x.n").cast("long").alias("n_item"), F.round(F.col("x.shared") / F.col("x.n"), 6).alias("containment"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') w FROM benchmark),
bw AS (SELECT item_id, w, least(len(w), 5) k FROM b WHERE len(w) > 0),
bs AS (SELECT DISTINCT item_id, k, unnest(list_transform(range(1, CAST(len(w) - k + 2 AS BIGINT)), lambda i: array_to_string(w[i:i + k - 1], ' '))) s FROM bw),
n AS (SELECT item_id, count(*) n FROM bs GROUP BY 1),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, CAST(len(w) - k + 2 AS BIGINT)), lambda i: array_to_string(w[i:i + k - 1], ' '))) s FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k),
m AS (SELECT doc_id, item_id, count(*) c FROM ds JOIN bs USING (s) GROUP BY 1, 2)
SELECT doc_id, item_id, c AS n_shared, n AS n_item, round(c / n, 6) AS containment FROM m JOIN n USING (item_id) WHERE c * 100 >= n * 80
"""

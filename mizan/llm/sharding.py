"""Sharding by fixed virtual slots and a versioned slot-to-shard map (operator 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mizan.llm.common import Scratch, read

#: Hex digits of the hash that name a virtual slot: 16 ** 3 slots, for good.
SLOT_DIGITS = 3
SLOTS = 16**SLOT_DIGITS
#: Parts of a slot that are numbered apart, so that no slot is numbered by one task.
PARTS = 64


def with_slots(docs: DataFrame) -> DataFrame:
    """docs and virtual_slot (from doc_id), size (UTF-8 bytes and 1), text_crc32."""
    digits = F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, SLOT_DIGITS)
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({"virtual_slot": F.conv(digits, 16, 10).cast("int"), "size": (F.octet_length(text) + 1).cast("long"), "text_crc32": F.crc32(text.cast("binary"))})


def slot_bytes(slotted: DataFrame) -> DataFrame:
    """(virtual_slot, bytes), SLOTS rows at most."""
    return slotted.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"))


def first_map(spark: SparkSession, shards: int) -> DataFrame:
    """(virtual_slot, shard) of version 1: slots in equal ranges."""
    return spark.range(SLOTS).select(F.col("id").cast("int").alias("virtual_slot"), F.floor(F.col("id") * shards / SLOTS).cast("int").alias("shard"))


def rebalance(current: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The next version of a map(virtual_slot, shard) for so many shards and slots of these bytes.

    A shard keeps its largest slots up to the mean; the others are given, largest first, to the shard that holds least.
    Both tables have SLOTS rows at most, and so has the one row in which the greedy step runs.
    """
    every = current.join(sizes, "virtual_slot", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0)))
    mean = every.agg(F.floor(F.sum("bytes") / shards).alias("mean"))
    run = Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot").rowsBetween(Window.unboundedPreceding, 0)
    ranked = every.crossJoin(F.broadcast(mean)).withColumn("kept", (F.sum("bytes").over(run) <= F.col("mean")) & (F.col("shard") < shards))
    loads = ranked.filter("kept").groupBy("shard").agg(F.sum("bytes").alias("load"))
    loads = loads.agg(F.map_from_entries(F.collect_list(F.struct("shard", "load"))).alias("m"))
    loads = loads.select(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0).cast("long"))).alias("loads"))
    loose = ranked.filter("not kept").agg(F.sort_array(F.collect_list(F.struct("bytes", "virtual_slot")), asc=False).alias("loose"))
    start = "named_struct('loads', loads, 'given', cast(array() as array<int>))"
    step = "named_struct('loads', transform(s.loads, (x, i) -> if(i = array_position(s.loads, array_min(s.loads)) - 1, x + z.bytes, x)), 'given', array_append(s.given, cast(array_position(s.loads, array_min(s.loads)) - 1 as int)))"
    given = loose.crossJoin(loads).select(F.explode(F.expr(f"arrays_zip(loose.virtual_slot, aggregate(loose, {start}, (s, z) -> {step}, s -> s.given))")).alias("g"))
    moved = given.select(F.col("g.virtual_slot").alias("virtual_slot"), F.col("g.1").alias("shard"))
    return ranked.filter("kept").select("virtual_slot", "shard").unionByName(moved)


class ShardMap:
    """Versions of a slot-to-shard map, each a table (virtual_slot, shard) of its own under root; none is overwritten."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def store(self, version: int, table: DataFrame) -> DataFrame:
        table.coalesce(1).write.mode("errorifexists").parquet(f"{self.root}/version={version}")
        return self.load(version)

    def load(self, version: int) -> DataFrame:
        return self.spark.read.schema("virtual_slot int, shard int").parquet(f"{self.root}/version={version}")

    def edited(self, version: int, sizes: DataFrame, shards: int) -> DataFrame:
        """Version + 1, rebalanced by these sizes."""
        return self.store(version + 1, rebalance(self.load(version), sizes, shards))


def place(docs: DataFrame, table: DataFrame) -> DataFrame:
    """docs with_slots, their shard by the map, and slot: a number in the shard, gapless from 0.

    Numbers come from counts: of the slots before in the shard, of the parts before in the slot, of the rows before in
    the part; so a hot id is numbered in parts. The table of offsets has SLOTS * PARTS rows at most and is broadcast.
    """
    rows = with_slots(docs)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(PARTS)).cast("int"))  # from values, so a second reading parts alike
    counts = rows.groupBy("virtual_slot", "part").agg(F.count("*").alias("n"))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    ahead = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    whole = counts.groupBy("virtual_slot").agg(F.sum("n").alias("n")).join(F.broadcast(table), "virtual_slot")
    whole = whole.select("virtual_slot", "shard", ahead("n", before("shard").orderBy("virtual_slot")).alias("slots_before"))
    parts = counts.select("virtual_slot", "part", ahead("n", before("virtual_slot").orderBy("part")).alias("parts_before"))
    offsets = parts.join(whole, "virtual_slot").select("virtual_slot", "part", "shard", (F.col("slots_before") + F.col("parts_before")).alias("offset"))
    within = Window.partitionBy("virtual_slot", "part").orderBy("doc_id", "text_crc32")
    numbered = rows.drop("text").withColumn("row", F.row_number().over(within) - 1)
    return numbered.join(F.broadcast(offsets), ["virtual_slot", "part"]).withColumn("slot", F.col("offset") + F.col("row")).drop("row", "offset", "part")


def shard(spark: SparkSession, docs: DataFrame, shards: int = 16, maps: ShardMap | None = None) -> DataFrame:
    """Every row of docs(doc_id, text) in one of the shards, sizes near equal (law `bytes`).

    Null texts: no bytes, size 1. Null doc_ids: one slot, numbered in parts like any. Repeated rows: each has a number
    of its own. An empty table: no rows. A single row larger than a shard's mean fills a shard alone. Other columns are
    not looked at.
    """
    base = docs.select("doc_id", "text")
    maps = maps or ShardMap(spark, Scratch(spark, "shards").path("map"))
    maps.store(1, first_map(spark, shards))
    table = maps.edited(1, slot_bytes(with_slots(base)), shards)
    return place(base, table)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard(spark, read(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")

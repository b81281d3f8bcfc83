"""MinHash near-duplicates: circulant signatures, banding, exact verification, components (operator 10)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mizan.llm.common import Scratch, read
from mizan.llm.components import components
from mizan.llm.words import U, mix, pieces, shingle_sets, words

def banding(threshold: float, coordinates: int = 192, miss: float = 1e-6) -> tuple[int, int]:
    """(bands, rows): the most rows a band with which a pair at the threshold is missed with a chance of at most miss."""
    for rows in range(12, 1, -1):
        bands = coordinates // rows
        if (1 - threshold**rows) ** bands <= miss:
            return bands, rows
    return coordinates, 1


def permute(x: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """The second permutation, pi: a bijection of 32-bit numbers, in place."""
    np.right_shift(x, np.uint32(16), out=spare)
    np.bitwise_xor(x, spare, out=x)
    np.multiply(x, np.uint32(0x85EBCA6B), out=x)
    np.right_shift(x, np.uint32(13), out=spare)
    np.bitwise_xor(x, spare, out=x)
    np.multiply(x, np.uint32(0xC2B2AE35), out=x)
    return x


def signatures(value: np.ndarray, at: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash (Li and Li, 2022). sigma, the first permutation, is the mixed shingle hash; coordinate k is the
    least pi(sigma(shingle) - k mod 2**32): the one permutation pi, shifted circularly k times. Sets must not be empty."""
    sigma = (value >> U(32)).astype(np.uint32)
    out = np.empty((len(at) - 1, coordinates), np.uint32)
    block = 1 << 16
    i = 0
    while i < len(at) - 1:  # so many sets at once that they stay in the processor's cache
        j = max(i + 1, int(np.searchsorted(at, at[i] + block, side="right")) - 1)
        part, begin = sigma[at[i] : at[j]], at[i:j] - at[i]
        moved, spare = np.empty_like(part), np.empty_like(part)
        for k in range(coordinates):
            np.subtract(part, np.uint32(k), out=moved)
            out[i:j, k] = np.minimum.reduceat(permute(moved, spare), begin)
        i = j
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    keys = np.zeros((len(signature), bands), np.uint64)
    for j in range(rows):
        keys = mix(keys * U(3) + signature[:, j : bands * rows : rows].astype(np.uint64) + U(1))
    return keys


def signature_bits(signature: np.ndarray) -> np.ndarray:
    """One bit of each coordinate, 64 to a number: two sets' bits differ with half the chance that coordinates do."""
    bits = (signature * np.uint32(0x9E3779B1)) >> np.uint32(31)
    return np.packbits(bits.astype(np.uint8), axis=1).view(np.int64)


def most_differing(threshold: float, coordinates: int, miss: float = 1e-6) -> int:
    """Bits in which signatures of a pair at the threshold differ at most, but for a chance of miss (Chernoff's bound)."""
    p = (1 - threshold) / 2
    for k in range(int(p * coordinates) + 1, coordinates):
        q = k / coordinates
        if math.exp(-coordinates * (q * math.log(q / p) + (1 - q) * math.log((1 - q) / (1 - p)))) <= miss:
            return k
    return coordinates


def content_key(value: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, in two halves; 0 for a set without members."""
    full = np.diff(at) > 0
    out = np.zeros((2, len(at) - 1), np.int64)
    for half, salt in zip(out, (U(0x5851F42D4C957F2D), U(0x14057B7EF767814F)), strict=True):
        if full.any():
            half[full] = np.add.reduceat(mix(value ^ salt), at[:-1][full]).view(np.int64)
    return out[0], out[1]


def sketch(docs: DataFrame, shingle: int, bands: int, rows: int, coordinates: int) -> DataFrame:
    """(doc_id, n, h1, h2, bands, bits): size, 128-bit content key, band keys and bits of each text's shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                value, at = shingle_sets(words(part.column("text")), shingle)
                n = np.diff(at)
                full = n > 0
                begin = at[:-1][full]
                h1, h2 = content_key(value, at)
                keys, bits = np.zeros((0, bands), np.uint64), np.zeros((0, coordinates // 64), np.int64)
                if full.any():
                    coordinate = signatures(value, np.append(begin, at[-1]), coordinates)
                    keys, bits = band_keys(coordinate[:, : bands * rows], bands, rows), signature_bits(coordinate)
                lists = []
                for x in (keys, bits):
                    ends = np.concatenate([[0], np.cumsum(full * x.shape[1])]).astype(np.int32)
                    lists.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(x.ravel().view(np.int64))))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(h1), pa.array(h2), *lists], ["doc_id", "n", "h1", "h2", "bands", "bits"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, h1 long, h2 long, bands array<long>, bits array<long>")


def full_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(rep, h1, items): the whole shingle set of each text, and half of its content key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                value, at = shingle_sets(words(part.column("text")), shingle)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(value.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(content_key(value, at)[0]), lists], ["rep", "h1", "items"])

    return docs.select("doc_id", "text").mapInArrow(run, "rep long, h1 long, items array<long>")


def holding(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs whose doc_id is among ids(doc_id), which has each once.

    A table of 2**24 bits, in 262,144 rows at most, goes to every task first and lets only hashes of ids through, so a
    small share of the texts is shuffled for the join that decides. That is an inner join: Spark would move a semi join
    to where all texts still are."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 24))
    word, bit = F.shiftright(place, 6), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
    table = ids.groupBy(word.alias("__word")).agg(F.bit_or(bit).alias("__bits"))
    likely = docs.withColumns({"__word": word, "__bit": bit}).join(F.broadcast(table), "__word").filter("__bits & __bit <> 0")
    return likely.select(*docs.columns).join(ids, "doc_id")


def verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Those of pairs(a, b) whose whole sets have 100 * intersection >= threshold * union."""
    left = pairs.join(sets.select(F.col("rep").alias("a"), F.col("items").alias("sa")), "a")
    both = left.join(sets.select(F.col("rep").alias("b"), F.col("items").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    return both.select("a", "b", common.alias("i"), (F.size("sa") + F.size("sb")).cast("long").alias("t")).filter(
        F.expr(f"100 * i >= {threshold} * (t - i)")
    ).select("a", "b")


def by_name(rows: DataFrame, name: str, *columns: str) -> DataFrame:
    """The columns with a suffix, for one side of a pair."""
    return rows.select(*[F.col(c).alias(f"{c}_{name}") for c in columns])


class Search:
    """Which pairs can be links at all; the checks are exact, but for signature bits (a chance of one in a million)."""

    def __init__(self, threshold: int, coordinates: int):
        self.threshold, self.numbers, self.differ = threshold, coordinates // 64, most_differing(threshold / 100, coordinates)

    def plausible(self, x: str, y: str) -> Column:
        """Sizes and signature bits of both sides are near enough."""
        n, m = F.col(f"n_{x}"), F.col(f"n_{y}")
        apart = sum(F.bit_count(F.col(f"bits_{x}")[i].bitwiseXOR(F.col(f"bits_{y}")[i])) for i in range(self.numbers))
        return (F.least(n, m) * 100 >= F.greatest(n, m) * self.threshold) & (apart <= self.differ)


def near_duplicates(spark: SparkSession, docs: DataFrame, *, shingle: int = 5, threshold: int = 80, coordinates: int = 384) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs(doc_id, text).

    Texts are sets of distinct runs of `shingle` words; two are linked if 100 * intersection >= threshold * union, which
    is always confirmed on the whole sets. component_id: the smallest doc_id that links lead to; kept: it is the row's own.

    Equal sets are one class from the start, so copies make no pairs. Classes that share a band's key are candidates:

    1. Each bucket's members are compared with its hub, the member that shares most buckets with others. Members of one
       component need no further comparison, so a group of copies costs work in proportion to its size.
    2. Where a bucket still holds more than one component, members with a plausible partner in another one stay. They
       meet by their rarest shingles: two sets at the threshold share one among the first of each, shingles ordered by
       how many sets hold them, and where the first they share stands bounds what they can share at all (Xiao and
       others, 2008). So a member that is far from all others meets few, however many share its frequent shingles.

    No candidate is capped or dropped: every pair that could be a link is compared, or lies in one component already.

    Null and empty texts, and texts of white space: no shingles, a component of their own. Texts shorter than a shingle:
    their whole sequence is the one shingle. A null doc_id: component null, kept. Repeated doc_ids: each row is judged;
    rows with one id are one node of the graph. An empty table: no rows. Further columns are not looked at.
    """
    bands, rows = banding(threshold / 100, coordinates // 2)
    search = Search(threshold, coordinates)
    tmp = Scratch(spark, "neardup")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    seen = tmp.keep(sketch(base, shingle, bands, rows, coordinates), "sketch")
    some = seen.filter("n > 0 and doc_id is not null")
    # one class for each different set; its representative is its smallest doc_id
    classes = tmp.keep(some.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep"), F.first(F.struct("bands", "bits")).alias("sig")), "classes")
    member = tmp.keep(some.select("doc_id", "n", "h1", "h2").join(classes.select("n", "h1", "h2", "rep"), ["n", "h1", "h2"]).select("doc_id", "n", "rep"), "members")
    # a doc_id of several classes links them
    least = member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).filter("a < z")
    same = tmp.keep(member.join(least, "doc_id").filter("rep > a").select("a", F.col("rep").alias("b")).distinct(), "same")

    offers = classes.select("rep", "n", F.posexplode("sig.bands").alias("band", "key"))
    shared = offers.groupBy("band", "key").agg(F.count("*").alias("size")).filter("size > 1")
    bucket = tmp.keep(offers.join(shared, ["band", "key"]).select("band", "key", "size", "rep", "n"), "buckets")
    weighted = bucket.join(bucket.groupBy("rep").agg(F.sum("size").alias("weight")), "rep")
    hubs = weighted.groupBy("band", "key").agg(F.max(F.struct("weight", F.xxhash64("rep").alias("p"), "rep"))["rep"].alias("hub"))
    star = bucket.join(hubs, ["band", "key"]).filter("rep <> hub").select(F.least("rep", "hub").alias("rep_a"), F.greatest("rep", "hub").alias("rep_b")).distinct()
    bits = classes.select("rep", "n", F.col("sig.bits").alias("bits"))
    met = star.join(by_name(bits, "a", "rep", "n", "bits"), "rep_a").join(by_name(bits, "b", "rep", "n", "bits"), "rep_b")
    tested = tmp.keep(met.filter(search.plausible("a", "b")).select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")), "tested-0")

    def sets_of(reps: DataFrame, name: str) -> DataFrame:
        """Whole sets of these, one row for each different set of a rep."""
        wanted = holding(base, reps.select(F.col("rep").alias("doc_id")).distinct())
        return tmp.keep(full_sets(wanted, shingle).dropDuplicates(["rep", "h1"]), name)

    every = tested.select(F.col("a").alias("rep")).union(tested.select("b"))
    links = tmp.keep(verified(tested, sets_of(every, "sets-0"), threshold), "links-0")
    tmp.drop("sets-0")
    found = same.union(links)
    comp = tmp.keep(components(found, tmp, "comp-0"), "roots-0")

    def in_parts(rows: DataFrame) -> DataFrame:
        """Rows with their root, of buckets that hold more than one."""
        placed = rows.join(comp.withColumnRenamed("id", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
        open_ = placed.groupBy("band", "key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("band", "key")
        return placed.join(open_, ["band", "key"])

    live = tmp.keep(in_parts(bucket.select("band", "key", "rep")).join(bits, "rep").select("band", "key", "rep", "n", "bits", "root"), "live")
    one, other = (by_name(live, x, "band", "key", "rep", "n", "bits", "root") for x in "xy")
    meet = (F.col("band_x") == F.col("band_y")) & (F.col("key_x") == F.col("key_y")) & (F.col("root_x") != F.col("root_y")) & search.plausible("x", "y")
    pool = tmp.keep(one.join(other, meet, "left_semi").select(*[F.col(f"{c}_x").alias(c) for c in ("rep", "n", "bits", "root")]).distinct(), "pool")
    tmp.drop("live", "buckets")
    sets = sets_of(pool, "sets-1")
    each = sets.select("rep", "h1", F.explode("items").alias("item"))
    often = each.groupBy("item").agg(F.count("*").alias("often"))
    ranked = each.join(often, "item").groupBy("rep", "h1").agg(F.array_sort(F.collect_list(F.struct("often", "item"))).alias("items"))  # a text's own set
    rarest = F.slice("items", 1, F.size("items") - F.ceil(F.size("items") * threshold / 100).cast("int") + 1)
    begin = ranked.select("rep", F.size("items").cast("long").alias("n"), F.posexplode(rarest).alias("i", "x")).select("rep", "n", "i", "x.item")
    begin = tmp.keep(begin.join(pool, ["rep", "n"]), "begins")
    one, other = (by_name(begin, x, "item", "i", "rep", "n", "bits", "root") for x in "xy")
    enough = F.least(F.col("n_x") - F.col("i_x"), F.col("n_y") - F.col("i_y")) * (100 + threshold) >= (F.col("n_x") + F.col("n_y")) * threshold
    meet = (F.col("item_x") == F.col("item_y")) & (F.col("root_x") < F.col("root_y")) & enough & search.plausible("x", "y")
    pairs = tmp.keep(one.join(other, meet).select(F.col("rep_x").alias("a"), F.col("rep_y").alias("b")).distinct(), "tested-1")
    found = found.union(tmp.keep(verified(pairs, sets, threshold), "links-1"))
    comp = tmp.keep(components(found, tmp, "comp-1"), "roots-1")
    tmp.drop("sets-1", "tested-0", "tested-1", "begins")
    roots = member.join(comp.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", "n", F.coalesce("root", "rep").alias("root"))
    alone = seen.filter("not (n > 0 and doc_id is not null)").select("doc_id", "n", F.col("doc_id").alias("root"))
    out = roots.unionByName(alone)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("root").alias("component_id"), F.col("root").eqNullSafe(F.col("doc_id")).alias("kept"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, read(spark, sf_dir, "documents"), shingle=3, threshold=85)

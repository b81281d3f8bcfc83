"""Document fingerprints: a homomorphic multiset hash of paragraphs (operator 3)."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mizan.llm.common import read
from mizan.llm.words import BYTE_VALUE, U, Words, buffers, mix, pieces, window_hashes, words

#: Lanes of 64 bits hashed from the whole paragraph (equality), and of 32 bits from its word shingles (likeness).
WIDE, NARROW, SHINGLE = 16, 256, 3
#: A paragraph of fewer words is sketched by runs of bytes instead.
SHORT, GRAM = 6, 4


def by_byte(column: pa.Array) -> Words:
    """Each byte a word of its own."""
    data, at = buffers(column)
    return Words(data, at, np.arange(len(data)), np.arange(1, len(data) + 1), mix(BYTE_VALUE[data]), at, {})


class Fingerprints:
    """One fingerprint for each of several multisets of paragraphs: sums of their vectors, modulo 2**64 and 2**32.

    Sums do not depend on order, and a paragraph is inserted or deleted by adding or subtracting its vector.
    """

    def __init__(self, wide: np.ndarray, narrow: np.ndarray):
        self.wide, self.narrow = wide, narrow

    @classmethod
    def of(cls, paragraphs: list[str], owner: np.ndarray, n: int) -> Fingerprints:
        """owner: which of the n multisets each paragraph is in, ascending."""
        wide = np.zeros((n, WIDE), np.uint64)
        if len(paragraphs):
            lanes = np.frombuffer(b"".join(hashlib.shake_128(p.encode("utf-8", "surrogatepass")).digest(8 * WIDE) for p in paragraphs), "<u8").reshape(-1, WIDE)
            some, at = np.unique(owner, return_index=True)
            wide[some] = np.add.reduceat(lanes, at, axis=0)
        w = words(pa.array(paragraphs, pa.string()))
        run, at = window_hashes(w, SHINGLE)
        row = np.repeat(owner, np.diff(at))
        short = np.diff(w.first) < SHORT
        long = np.repeat(~short, np.diff(at))
        grams, at = window_hashes(by_byte(pa.array(paragraphs, pa.string()).filter(pa.array(short))), GRAM)
        run, row = np.concatenate([run[long], grams]), np.concatenate([row[long], np.repeat(owner[short], np.diff(at))])
        sign = np.where(run & U(1 << 20), 1.0, -1.0)
        narrow = np.bincount(row * NARROW + (run % U(NARROW)).astype(np.int64), sign, n * NARROW).reshape(n, NARROW)
        return cls(wide, narrow.astype(np.int64).astype(np.uint32))

    def __add__(self, other: Fingerprints) -> Fingerprints:
        return Fingerprints(self.wide + other.wide, self.narrow + other.narrow)

    def __sub__(self, other: Fingerprints) -> Fingerprints:
        return Fingerprints(self.wide - other.wide, self.narrow - other.narrow)

    def take(self, rows: slice) -> Fingerprints:
        return Fingerprints(self.wide[rows], self.narrow[rows])

    def likeness(self, other: Fingerprints) -> np.ndarray:
        """0 to 1: the share of the two multisets that is in both, as their sketches' second moments give it. A shingle
        adds 1 or -1 to one lane, so the squared length of a difference estimates how many shingles differ."""
        power = lambda x: (x.narrow.view(np.int32).astype(np.float64) ** 2).sum(1)
        both = power(self) + power(other)
        apart = power(self - other)
        equal = (self.wide == other.wide).all(1)
        near = np.clip(1 - apart / np.maximum(both, 1), 0, 1)
        return np.where(equal, 1.0, np.where(both > 0, np.minimum(near, 1 - 1e-9), 0.0))

    def texts(self) -> list[str]:
        raw = np.concatenate([self.wide.astype("<u8").view(np.uint8), self.narrow.astype("<u4").view(np.uint8)], axis=1)
        return [base64.b64encode(r.tobytes()).decode() for r in raw]


def paragraphs_of(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Lines that hold anything, and which text each is of."""
    split = [[p for p in t.split("\n") if p] for t in texts]
    return [p for s in split for p in s], np.repeat(np.arange(len(texts)), [len(s) for s in split])


def fingerprints(texts: list[str]) -> Fingerprints:
    return Fingerprints.of(*paragraphs_of(texts), len(texts))


def edited_texts(texts: list[str], following: list[str]) -> list[str]:
    """The last quarter of each text's code points replaced by the first as many of the one that follows it."""
    return [t[: len(t) - len(t) // 4] + f[: len(t) // 4] for t, f in zip(texts, following, strict=True)]


def edited_fingerprints(before: Fingerprints, texts: list[str], edited: list[str]) -> Fingerprints:
    """Fingerprints after an edit, from those before it: lines that changed are deleted and inserted."""
    gone, new = [], []
    for t, e in zip(texts, edited, strict=True):
        common = e.rfind("\n", 0, len(t) - len(t) // 4) + 1  # what stands before is the same in both
        gone.append(t[common:])
        new.append(e[common:])
    return before - fingerprints(gone) + fingerprints(new)


def in_order(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(place, order, doc_id, text, guest): docs in ranges of ascending doc_id, one for each partition, sorted, each
    ended by a guest: the first document of the next range (of the last range: the first of all).

    Range bounds come from the ids alone; as many as there are shuffle partitions, so they go to the driver. Texts are
    shuffled once. Null doc_ids come first, equal ones by a hash of the text.
    """
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    ids = docs.select(order.alias("order"))
    cuts = ids.agg(F.percentile_approx("order", [(i + 1) / n for i in range(n - 1)] or [0.5], 10_000).alias("q")).first()["q"] or []
    cuts = np.unique(np.array(cuts if n > 1 else [], np.int64))
    ranged = lambda ids: np.searchsorted(cuts, ids, side="left")  # noqa: E731  range i: up to cuts[i]

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low: dict[int, int] = {}
        for batch in batches:
            ids = batch.column(0).to_numpy()
            place = ranged(ids)
            for p in np.unique(place):
                m = int(ids[place == p].min())
                low[int(p)] = min(low.get(int(p), m), m)
        yield pa.RecordBatch.from_arrays([pa.array(list(low), pa.int32()), pa.array(list(low.values()), pa.int64())], ["place", "low"])

    lows = {r["place"]: r["low"] for r in ids.mapInArrow(least, "place int, low long").groupBy("place").agg(F.min("low").alias("low")).collect()}
    used = sorted(lows)
    visits = {lows[p]: used[i - 1] for i, p in enumerate(used)}  # the first of a range visits the range before it

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("order").to_numpy()
            home = pa.array(ranged(ids).astype(np.int32))
            yield pa.RecordBatch.from_arrays([home, *batch.columns, pa.array(np.zeros(len(ids), bool))], ["place", *batch.schema.names, "guest"])
            rows = np.flatnonzero(np.isin(ids, list(visits)))
            if len(rows):
                some = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array([visits[int(i)] for i in ids[rows]], pa.int32()), *some.columns, pa.array(np.ones(len(rows), bool))], ["place", *batch.schema.names, "guest"])

    dealt = docs.select(order.alias("order"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = dealt.mapInArrow(deal, "place int, order long, doc_id long, text string, guest boolean")
    return dealt.repartitionById(n, "place").sortWithinPartitions("place", "guest", "order", F.xxhash64("text"))


def compare(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """For every row of docs(doc_id, text): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next (see edited_texts and Fingerprints.likeness).

    Null and empty texts: no code points, the fingerprint of nothing; likeness 1 to another empty text, else 0. A single
    document follows itself. Repeated ids and equal texts: each row is its own. An empty table: no rows. Texts of one
    line have one wide vector; their likeness rests on word shingles. Further columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        texts: list[str] = []
        last = None  # the range of what waits
        done = False

        def out() -> pa.RecordBatch | None:
            """What has its follower; the last text waits for its own."""
            if len(texts) < 2:
                return None
            prints = fingerprints(texts)
            here, after = texts[:-1], texts[1:]
            mine = prints.take(slice(0, len(here)))
            new = edited_texts(here, after)
            moved = edited_fingerprints(mine, here, new)
            sums = [hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in new]
            cols = [pa.array(ids[:-1], pa.int64()), pa.array([len(t) for t in here], pa.int64()), pa.array(sums), pa.array(mine.texts()), pa.array(moved.texts()), pa.array(mine.likeness(moved)), pa.array(mine.likeness(prints.take(slice(1, None))))]
            del ids[:-1], texts[:-1]
            return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        for batch in batches:
            for part in pieces(batch, "text", 1 << 21):
                for place, doc, text, guest in zip(*(part.column(c).to_pylist() for c in ("place", "doc_id", "text", "guest")), strict=True):
                    if place != last:
                        if (b := out()) is not None:
                            yield b
                        ids.clear()
                        texts.clear()
                        last, done = place, False
                    if done:
                        continue  # a guest's copies
                    ids.append(doc)
                    texts.append(text)
                    done = guest
                if not done and (b := out()) is not None:
                    yield b
        if (b := out()) is not None:
            yield b

    return in_order(spark, docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare(spark, read(spark, sf_dir, "documents"))

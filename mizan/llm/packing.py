"""Packing by powers of two: every document is cut into pieces of binary length, equal lengths share a bucket (operator 13)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mizan.llm.common import Scratch, read
from mizan.llm.tokens import PIECE, encoder
from mizan.llm.words import filled, pieces

#: Tokens of the longest sequence, a power of two.
LENGTH = 2048


def cuts(sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pieces of documents of so many tokens, one document after another: each piece's document, its start there and
    its length. A document's lengths fall: as many of `length` as it holds, then the binary digits of what is left."""
    whole, left = sizes // length, sizes % length
    powers = length >> np.arange(1, length.bit_length())  # length / 2, ..., 1
    has = (left[:, None] & powers) > 0
    count = whole + has.sum(axis=1)
    doc = np.repeat(np.arange(len(sizes)), count)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    size = np.full(len(doc), length, np.int64)
    size[nth >= whole[doc]] = np.broadcast_to(powers, has.shape)[has]
    before = np.cumsum(size) - size
    first = np.cumsum(count) - count
    return doc, before - before[np.repeat(first, count)], size


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, root: str, *, end: int = 1, length: int = LENGTH) -> DataFrame:
    """Write docs(doc_id, text) as sequences under root and read them back.

    A sequence is one piece: (sequence_id, length, doc_id, start, doc_tokens, ids), ids being little-endian unsigned
    32-bit integers. Its length is a power of two and it lies in one document, so nothing is padded and no sequence
    crosses documents. Sequences of equal length are a bucket, numbered together, longest first and without gaps; files
    are sorted by length, so that a filter on it reads only that bucket's row groups.

    One pass without a shuffle: a task encodes its rows and numbers its pieces by length; the written table then gives
    what each task adds to its numbers, twelve counts a task, joined by whatever join their measured size allows.
    Null and empty texts: the end id alone, one sequence. Repeated rows and equal or null doc_ids: each row is a document
    of its own. Very long texts: encoded whole, in pieces of one task. An empty table: no rows. Other columns are not
    looked at.
    """
    assert length & (length - 1) == 0, "length must be a power of two"
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    steps = length.bit_length()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        task = TaskContext.get().partitionId()
        seen = np.zeros(steps, np.int64)
        for batch in filled(batches, "text", PIECE):
            for part in pieces(batch, "text", PIECE):
                ids, to = code.encode(part.column("text"), end)
                sizes = np.diff(to)
                doc, start, size = cuts(sizes, length)
                rank = np.log2(size).astype(np.int64)
                number = np.empty(len(size), np.int64)
                for k in np.unique(rank):
                    some = rank == k
                    number[some] = seen[k] + np.arange(some.sum())
                    seen[k] += some.sum()
                # pieces lie one after another in ids, so one offset array makes them values of a binary column
                at = np.concatenate([[0], np.cumsum(size)]) * 4
                for lo in range(0, len(size), 20_000):
                    hi = min(lo + 20_000, len(size))
                    raw = pa.py_buffer(ids[at[lo] // 4 : at[hi] // 4].astype("<u4").tobytes())
                    blobs = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((at[lo : hi + 1] - at[lo]).astype(np.int32)), raw])
                    rows = doc[lo:hi]
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id").take(pa.array(rows)), pa.array(start[lo:hi]), pa.array(size[lo:hi]), pa.array(sizes[rows].astype(np.int64)), pa.array(np.full(hi - lo, task, np.int32)), pa.array(number[lo:hi]), blobs],
                        ["doc_id", "start", "length", "doc_tokens", "task", "number", "ids"],
                    )

    cut = base.mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, task int, number long, ids binary")
    cut.sortWithinPartitions("length", "number").write.parquet(f"{root}/pieces")
    written = spark.read.schema(cut.schema).parquet(f"{root}/pieces")
    counts = written.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts.select("length", "task", "n", before.alias("before")).write.parquet(f"{root}/counts")
    tasks = spark.read.schema("length long, task int, n long, before long").parquet(f"{root}/counts")
    longer = Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket, twelve at most
    buckets = tasks.groupBy("length").agg(F.sum("n").alias("n")).select("length", F.coalesce(F.sum("n").over(longer), F.lit(0)).alias("first"))
    offsets = tasks.join(F.broadcast(buckets), "length").select("length", "task", (F.col("first") + F.col("before")).alias("offset"))
    offsets.write.parquet(f"{root}/offsets")
    numbered = written.join(spark.read.schema("length long, task int, offset long").parquet(f"{root}/offsets"), ["length", "task"])
    return numbered.select((F.col("offset") + F.col("number")).alias("sequence_id"), "length", "doc_id", "start", "doc_tokens", "ids")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    root = Scratch(spark, "packing").path("sequences")
    packed = pack(spark, read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), root)
    return packed.select("doc_id", "start", "length", F.crc32("ids").cast("long").alias("ids_crc32"), "doc_tokens", "sequence_id", F.lit(0).cast("long").alias("offset"))

"""LM scoring by a hierarchical Pitman-Yor model: seating sampled by Gibbs sweeps, averaged predictions (operator 4).

The model is a bigram one. Each context (the word before, hashed to 2**CONTEXT_BITS restaurants) is a restaurant whose
tables are customers of one shared parent, the root, whose tables draw words evenly from the vocabulary and one unknown.

How it is spread: tokens go to buckets by their word, so all customers of a word, and the root's tables for it, are in
one bucket and are seated by array arithmetic. What a bucket needs of others has a fixed bound: how many customers and
tables each restaurant has (2**CONTEXT_BITS numbers), and totals of hot words, which are dealt to buckets by word and
context. Buckets read the restaurants' sizes of the sweep before, as distributed samplers do.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mizan.llm.common import Scratch, read
from mizan.llm.toxicity import in_fold
from mizan.llm.words import U, mix, pieces, words

CONTEXT_BITS, BLOCK_BITS = 22, 14
#: Bytes of text whose tokens make one bucket, and that make one chunk of documents.
BUCKET, CHUNK = 12 << 20, 4 << 20
END, START = U(0x7FEA2B1D90C3E5A7), U(0x1B56C4E9F0A3D827)
#: Customers of one dish that are seated one by one; those after them come in lots of this share of those seated.
STEPWISE, BLOCK = 48, 0.125


def pack(a: np.ndarray) -> bytes:
    """An array's bytes, plane by plane, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes())


def unpack(b: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, len(raw) // size).T).view(kind).reshape(-1)


@dataclass
class Tokens:
    """word, context and document (its place in the column) of each token; first: where each document's begin."""

    word: np.ndarray
    context: np.ndarray
    doc: np.ndarray
    first: np.ndarray


def tokens_of(column: pa.Array, bits: int = CONTEXT_BITS) -> Tokens:
    """Words and one end for each text; before the first word stands the start."""
    w = words(column)
    word = np.insert(w.hashes, w.first[1:], END)
    first = w.first + np.arange(len(w.first))
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[first[:-1]] = START
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return Tokens(word, (mix(before.copy()) >> U(64 - bits)).astype(np.uint32), doc, first)


def spread_of(word: np.ndarray, context: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """64 bits whose order is that of the buckets: from the word; of a hot word, from word and context."""
    spread = mix(word.copy())
    if len(hot):
        warm = np.isin(word, hot)
        spread[warm] = mix(word[warm] ^ mix(context[warm].astype(np.uint64) + U(1)))
    return spread


def bucket_of(spread: np.ndarray, buckets: int) -> np.ndarray:
    return ((spread >> U(32)) * U(buckets) >> U(32)).astype(np.int32)


def seat(c: np.ndarray, d: float, theta: float, others: np.ndarray, parent: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes with c >= 1 customers each, seated one after another by the Chinese restaurant's rule: with n
    seated at k tables the next opens one with weight (theta + d (others + k)) parent, against n - d k.

    others: the restaurant's tables for other dishes; parent: the dish's probability in the parent restaurant. The first
    always opens one. Customers of a dish beyond STEPWISE are seated in lots, for which the weights stand still at the
    lot's middle, so a dish's work grows with the logarithm of its customers.
    """
    k = np.ones(len(c), np.int64)
    order = np.argsort(-c, kind="stable")
    size = c[order]
    n, most = 1, int(size[0]) if len(size) else 1
    while n < most:
        some = order[: np.searchsorted(-size, -n, side="left")]  # those with more than n customers
        weight = (theta + d * (others[some] + k[some])) * parent[some]
        new = weight / (weight + n - d * k[some] + (BLOCK * n // 2 if n >= STEPWISE else 0))
        if n < STEPWISE:
            k[some] += rng.random(len(some)) < new
            n += 1
        else:
            step = max(1, int(BLOCK * n))
            k[some] += rng.binomial(np.minimum(c[some] - n, step), new)
            n += step
    return k


@dataclass
class Sample:
    """What all buckets share of one sweep: tables by restaurant, customers and tables at the root, those of hot words."""

    tables: np.ndarray
    customers1: int
    tables1: int
    hot: dict[int, tuple[int, int]] = field(default_factory=dict)


@dataclass
class Shape:
    """What all buckets share of the counts; customers: by restaurant. known, distinct: N and V; hot: a hot word's training count."""

    buckets: int
    known: int
    distinct: int
    d: float
    d1: float
    theta: float
    theta1: float
    customers: np.ndarray
    hot: dict[int, int]

    def root(self, c1: np.ndarray, t1: np.ndarray, s: Sample) -> np.ndarray:
        """The root's predictive probability of words with c1 customers at t1 tables."""
        return (np.maximum(c1 - self.d1 * t1, 0) + (self.theta1 + self.d1 * s.tables1) / (self.distinct + 1)) / (self.theta1 + s.customers1)


def share(spark: SparkSession, shape: Shape, samples: dict[int, Sample]):
    """Both as a broadcast: arrays of 2**CONTEXT_BITS numbers, packed, and a bounded number of hot words."""
    small = {n: replace(s, tables=(pack(s.tables), s.tables.dtype)) for n, s in samples.items()}
    return spark.sparkContext.broadcast((replace(shape, customers=(pack(shape.customers), shape.customers.dtype)), small))


def shared_by(value: tuple[Shape, dict[int, Sample]]) -> tuple[Shape, dict[int, Sample]]:
    shape, samples = value
    return replace(shape, customers=unpack(*shape.customers)), {n: replace(s, tables=unpack(*s.tables)) for n, s in samples.items()}


def blocks_of(context: np.ndarray, n: np.ndarray) -> list[dict]:
    """Sums of n by restaurant, in blocks of 2**BLOCK_BITS restaurants."""
    order = np.argsort(context, kind="stable")
    context, n = context[order], n[order]
    used, at = np.unique(context >> BLOCK_BITS, return_index=True)
    at = np.append(at, len(context))
    return [{"block": int(b), "data": pack(np.bincount(context[i:j] & ((1 << BLOCK_BITS) - 1), n[i:j], 1 << BLOCK_BITS).astype(np.int64))} for b, i, j in zip(used, at[:-1], at[1:], strict=True)]


BLOCKS = "array<struct<block: int, data: binary>>"
STATE = f"bucket int, words binary, at binary, context binary, c binary, known long, ones long, twos long, distinct long, root1 long, root2 long, hot binary, hot_c binary, blocks {BLOCKS}, tokens array<struct<chunk: long, pair: binary, doc: binary>>, metas array<struct<chunk: long, docs: binary, held: binary, nulls: binary, n: binary>>"
SWEPT = f"customers1 long, tables1 long, hot binary, hot_c1 binary, blocks {BLOCKS}"


def deal(docs: DataFrame, buckets: int, hot: np.ndarray, bits: int) -> DataFrame:
    """(bucket, chunk, words, counts, contexts, docs, meta): each chunk's tokens for each bucket, word by
    word; a chunk's documents themselves are dealt to one bucket, with no tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in pieces(batch, "text", CHUNK):
                t = tokens_of(part.column("text"), bits)
                spread = spread_of(t.word, t.context, hot)
                order = np.argsort(spread, kind="stable")
                home, word, context, doc = bucket_of(spread[order], buckets), t.word[order], t.context[order], t.doc[order].astype(np.uint32)
                used, at = np.unique(home, return_index=True)
                rows = []
                for b, i, j in zip(used, at, [*at[1:], len(home)], strict=True):
                    new = np.flatnonzero(np.concatenate([[True], word[i + 1 : j] != word[i : j - 1]]))
                    rows.append((int(b), chunk, pack(word[i:j][new]), pack(np.diff(np.append(new, j - i)).astype(np.uint32)), pack(context[i:j]), pack(doc[i:j]), None))
                ids = part.column("doc_id")
                meta = {"docs": pack(ids.fill_null(0).to_numpy()), "held": pack(part.column("held").to_numpy(zero_copy_only=False)), "nulls": pack(ids.is_null().to_numpy(zero_copy_only=False)), "n": pack(np.diff(t.first))}
                rows.append((int(mix(np.array([chunk], np.uint64))[0] % U(buckets)), chunk, None, None, None, None, meta))
                # which documents teach is known to every bucket of the chunk
                held = pack(part.column("held").to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_pylist([dict(zip(("bucket", "chunk", "words", "counts", "contexts", "docs", "meta"), r, strict=True)) | {"held": held} for r in rows], DEALT)
                chunk += 1

    schema = "bucket int, chunk long, words binary, counts binary, contexts binary, docs binary, meta struct<docs: binary, held: binary, nulls: binary, n: binary>, held binary"
    return docs.mapInArrow(run, schema)


_BLOBS = pa.struct([(k, pa.binary()) for k in ("docs", "held", "nulls", "n")])
DEALT = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("words", pa.binary()), ("counts", pa.binary()), ("contexts", pa.binary()), ("docs", pa.binary()), ("meta", _BLOBS), ("held", pa.binary())])
_BLOCKS = pa.list_(pa.struct([("block", pa.int32()), ("data", pa.binary())]))
_STATE = pa.schema(
    [("bucket", pa.int32()), ("words", pa.binary()), ("at", pa.binary()), ("context", pa.binary()), ("c", pa.binary())]
    + [(k, pa.int64()) for k in ("known", "ones", "twos", "distinct", "root1", "root2")]
    + [("hot", pa.binary()), ("hot_c", pa.binary()), ("blocks", _BLOCKS), ("tokens", pa.list_(pa.struct([("chunk", pa.int64()), ("pair", pa.binary()), ("doc", pa.binary())])))]
    + [("metas", pa.list_(pa.struct([("chunk", pa.int64()), *[(k, pa.binary()) for k in ("docs", "held", "nulls", "n")]])))]
)
_SWEPT = pa.schema([("customers1", pa.int64()), ("tables1", pa.int64()), ("hot", pa.binary()), ("hot_c1", pa.binary()), ("blocks", _BLOCKS)])


def gather(dealt: DataFrame, hot: np.ndarray) -> DataFrame:
    """One row for each bucket: its distinct (word, context) pairs with training counts, its tokens as pairs and
    documents, by chunk, and sums that all buckets need."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        own = [r for r in rows if r["meta"] is None]
        metas = [r["meta"] | {"chunk": r["chunk"]} for r in rows if r["meta"] is not None]
        z = lambda t: np.zeros(0, t)
        parts = [unpack(r["words"], np.uint64) for r in own]
        terms = np.unique(np.concatenate(parts or [z(np.uint64)]))
        rank = np.concatenate([np.repeat(np.searchsorted(terms, p), unpack(r["counts"], np.uint32)) for p, r in zip(parts, own, strict=True)] or [z(np.int64)])
        context = np.concatenate([unpack(r["contexts"], np.uint32) for r in own] or [z(np.uint32)])
        docs = [unpack(r["docs"], np.uint32) for r in own]
        teaches = np.concatenate([~unpack(r["held"], np.bool_)[d] for r, d in zip(own, docs, strict=True)] or [z(bool)])
        both = (rank.astype(np.uint64) << U(32)) | context
        order = np.argsort(both, kind="stable")
        both, rank, context = both[order], None, None
        new = np.ones(len(both), bool)
        new[1:] = both[1:] != both[:-1]
        pair = np.empty(len(both), np.int64)
        pair[order] = np.cumsum(new) - 1
        both = both[new]
        x = both.astype(np.uint32)
        n = int(new.sum())
        c = np.bincount(pair[teaches], minlength=n).astype(np.int64)
        at = np.searchsorted(both >> U(32), np.arange(len(terms) + 1, dtype=np.uint64))
        total = np.add.reduceat(c, at[:-1]) if len(terms) else c
        kinds = np.add.reduceat((c > 0).astype(np.int64), at[:-1]) if len(terms) else c
        warm = np.isin(terms, hot)
        size = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
        some = c > 0
        tokens = [{"chunk": r["chunk"], "pair": pack(np.diff(pair[i:j], prepend=0).astype(np.int32)), "doc": pack(d)} for r, d, i, j in zip(own, docs, size[:-1], size[1:], strict=True)]
        row = {"bucket": int(rows[0]["bucket"]), "words": pack(terms), "at": pack(at.astype(np.int32)), "context": pack(x), "c": pack(c.astype(np.int32) if not n or c.max() < 1 << 31 else c)}
        row |= {"known": int(c.sum()), "ones": int((c == 1).sum()), "twos": int((c == 2).sum()), "distinct": int(((total > 0) & ~warm).sum()), "root1": int((kinds == 1).sum()), "root2": int((kinds == 2).sum())}
        row |= {"hot": pack(terms[warm]), "hot_c": pack(total[warm]), "blocks": blocks_of(x[some], c[some]), "tokens": tokens, "metas": metas}
        return pa.Table.from_pylist([row], _STATE)

    return dealt.groupBy("bucket").applyInArrow(run, STATE)


def counts_of(b: bytes, n: int) -> np.ndarray:
    """Counts kept in 32 bits, or in 64 where one needs them."""
    raw = zstandard.ZstdDecompressor().decompress(b)
    return unpack(b, np.int32 if len(raw) == 4 * n else np.int64).astype(np.int64)


def by_block(rows: DataFrame, bits: int) -> np.ndarray:
    """The array of sums by restaurant, 2**bits numbers, from rows' blocks."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        total = sum(unpack(b, np.int64) for b in table["data"].to_pylist())
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([pack(total)], pa.binary())})

    summed = rows.select(F.explode("blocks").alias("b")).select("b.block", "b.data").groupBy("block").applyInArrow(run, "block int, data binary")
    out = np.zeros(max(1 << bits, 1 << BLOCK_BITS), np.int64)
    for r in summed.collect():  # 2**bits numbers at most
        out[r["block"] << BLOCK_BITS : (r["block"] + 1) << BLOCK_BITS] = unpack(bytes(r["data"]), np.int64)
    return out.astype(np.int32) if out.max() < 1 << 31 else out


def hot_sums(rows: DataFrame, value: str) -> dict[int, int]:
    """Totals of hot words over all buckets; there are 8 times as many as buckets at most."""
    out: dict[int, int] = {}
    for r in rows.select("hot", value).collect():
        for w, n in zip(unpack(bytes(r["hot"]), np.uint64).tolist(), unpack(bytes(r[value]), np.int64).tolist(), strict=True):
            out[w] = out.get(w, 0) + n
    return out


def hot_words(docs: DataFrame, buckets: int) -> np.ndarray:
    """Words that may make up more than an eighth of a bucket's share of all tokens, 16 times the buckets at most.

    A chunk tells of the words that are over half of that share of it; what is left out of such a word's count is then
    under half of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", CHUNK):
                w = words(part.column("text"))
                total = len(w.hashes) + part.num_rows
                u, n = np.unique(w.hashes, return_counts=True)
                u, n = np.append(u, [END, U(0)]), np.append(n, [part.num_rows, total])
                some = n * 16 * buckets >= total
                yield pa.RecordBatch.from_arrays([pa.array(u[some].view(np.int64)), pa.array(n[some].astype(np.int64))], ["word", "n"])

    told = docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    whole = told.filter("word = 0").select(F.col("n").alias("total"))
    found = told.filter("word <> 0").crossJoin(F.broadcast(whole)).filter(F.col("n") * 16 * buckets >= F.col("total")).select("word").toPandas()["word"]
    return np.sort(found.to_numpy(np.int64).view(np.uint64))


class Seats:
    """Tables of each bucket's pairs and words after each sweep: a file for each in the shared folder. Tasks write under
    a name of their own and rename, so one that is tried again does no harm."""

    def __init__(self, root: str):
        self.root = root

    def write(self, sweep: int, bucket: int, t: np.ndarray, t1: np.ndarray) -> None:
        fs, at = pa.fs.FileSystem.from_uri(self.root)
        fs.create_dir(f"{at}/{sweep}", recursive=True)
        mine = f"{at}/{sweep}/.{bucket}-{uuid.uuid4().hex}"
        with fs.open_output_stream(mine) as f:
            for x in (pack(t), pack(t1)):
                f.write(len(x).to_bytes(8, "little") + x)
        fs.move(mine, f"{at}/{sweep}/{bucket}")

    def read(self, sweep: int, bucket: int) -> tuple[np.ndarray, np.ndarray]:
        fs, at = pa.fs.FileSystem.from_uri(self.root)
        with fs.open_input_stream(f"{at}/{sweep}/{bucket}") as f:
            t, t1 = (unpack(f.read(int.from_bytes(f.read(8), "little")), np.int64) for _ in range(2))
        return t, t1


def sweep(state: DataFrame, seats: Seats, n: int, shared, seed: int) -> DataFrame:
    """Every bucket's pairs seated anew, then the root's tables for its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape, samples = shared_by(shared.value)
        (before,) = samples.values()
        for batch in batches:
            for r in batch.to_pylist():
                terms, at, context = unpack(r["words"], np.uint64), unpack(r["at"], np.int32), unpack(r["context"], np.uint32)
                c = counts_of(r["c"], len(context))
                t, t1 = seats.read(n - 1, r["bucket"]) if n else (np.minimum(c, 1), None)
                kinds = np.diff(at)
                add = lambda v, at=at, terms=terms: np.add.reduceat(v, at[:-1]) if len(terms) else v
                c1 = add(t)
                t1 = np.minimum(c1, 1) if t1 is None else t1
                hot = np.isin(terms, np.array(sorted(shape.hot), np.uint64))
                for i in np.flatnonzero(hot):
                    c1[i], t1[i] = before.hot[int(terms[i])]
                rng = np.random.default_rng([seed, r["bucket"]])
                parent = np.repeat(shape.root(c1, t1, before), kinds)
                some = np.flatnonzero(c > 1)
                old = np.maximum(before.tables[context[some]] - t[some], 0)
                t = np.minimum(c, 1)
                t[some] = seat(c[some], shape.d, shape.theta, old, parent[some], rng)
                c1 = add(t)
                warm = c1[hot]
                c1 = np.where(hot, 0, c1)
                t1 = np.zeros(len(terms), np.int64)
                many = np.flatnonzero(c1 > 0)
                even = np.full(len(many), 1 / (shape.distinct + 1))
                t1[many] = seat(c1[many], shape.d1, shape.theta1, np.full(len(many), before.tables1), even, rng)
                has = c > 0
                seats.write(n, r["bucket"], t, t1)
                row = {"customers1": int(c1.sum()), "tables1": int(t1.sum()), "hot": pack(terms[hot]), "hot_c1": pack(warm), "blocks": blocks_of(context[has], t[has])}
                yield pa.RecordBatch.from_pylist([row], _SWEPT)

    return state.select("bucket", "words", "at", "context", "c").mapInArrow(run, SWEPT)


def gathered(swept: DataFrame, shape: Shape, before: Sample, seed: int, bits: int) -> Sample:
    """What all buckets share after a sweep; hot words' root tables are seated here, a bounded number of dishes."""
    sums = swept.agg(F.coalesce(F.sum("customers1"), F.lit(0)).alias("c"), F.coalesce(F.sum("tables1"), F.lit(0)).alias("t")).first()
    hot = hot_sums(swept, "hot_c1")
    word, c1 = list(hot), np.array(list(hot.values()), np.int64)
    t1 = np.zeros(len(c1), np.int64)
    some = np.flatnonzero(c1 > 0)
    t1[some] = seat(c1[some], shape.d1, shape.theta1, np.full(len(some), before.tables1), np.full(len(some), 1 / (shape.distinct + 1)), np.random.default_rng(seed))
    return Sample(by_block(swept, bits), sums["c"] + int(c1.sum()), sums["t"] + int(t1.sum()), {w: (int(a), int(b)) for w, a, b in zip(word, c1, t1, strict=True)})


def partial_scores(state: DataFrame, seats: Seats, shared) -> DataFrame:
    """(chunk, docs, n_known, base, score, meta): each bucket's part of each document's sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape, samples = shared_by(shared.value)
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                terms, at, context = unpack(r["words"], np.uint64), unpack(r["at"], np.int32), unpack(r["context"], np.uint32)
                c, kinds = counts_of(r["c"], len(context)), np.diff(at)
                add = lambda v, at=at, terms=terms: np.add.reduceat(v, at[:-1]) if len(terms) else v
                total = add(c)
                hot = [(j, int(terms[j])) for j in np.flatnonzero(np.isin(terms, np.array(sorted(shape.hot), np.uint64)))]
                for j, w in hot:
                    total[j] = shape.hot[w]
                base = np.log10((total + 0.5) / (shape.known + 0.5 * (shape.distinct + 1)))
                base, known = np.repeat(base, kinds), np.repeat(total > 0, kinds)
                p = np.zeros(len(c))
                for n, s in samples.items():
                    t, t1 = seats.read(n, r["bucket"])
                    c1 = add(t)
                    for j, w in hot:
                        c1[j], t1[j] = s.hot[w]
                    up = np.repeat(shape.root(c1, t1, s), kinds)
                    p += (np.maximum(c - shape.d * t, 0) + (shape.theta + shape.d * s.tables[context]) * up) / (shape.theta + shape.customers[context])
                score = np.log10(p / len(samples))
                out = [{"chunk": m.pop("chunk"), "meta": m} for m in r["metas"]]
                for x in r["tokens"]:
                    pair, doc = np.cumsum(unpack(x["pair"], np.int32).astype(np.int64)), unpack(x["doc"], np.uint32)
                    some, row = np.unique(doc, return_inverse=True)
                    sums = [np.bincount(row, v[pair], len(some)) for v in (known, base, score)]
                    out.append({"chunk": x["chunk"], "docs": pack(some), "n_known": pack(sums[0].astype(np.uint32)), "base": pack(sums[1]), "score": pack(sums[2].astype(np.float32))})
                yield pa.RecordBatch.from_pylist(out, _PART)

    return state.select("bucket", "words", "at", "context", "c", "tokens", "metas").mapInArrow(run, "chunk long, docs binary, n_known binary, base binary, score binary, meta struct<docs: binary, held: binary, nulls: binary, n: binary>")


_PART = pa.schema([("chunk", pa.int64()), ("docs", pa.binary()), ("n_known", pa.binary()), ("base", pa.binary()), ("score", pa.binary()), ("meta", _BLOBS)])


def summed(parts: DataFrame, known: int) -> DataFrame:
    """A row for each document, from its chunk's parts."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        meta = next(r["meta"] for r in rows if r["meta"] is not None)
        ids, nulls = unpack(meta["docs"], np.int64), unpack(meta["nulls"], np.bool_)
        sums = {"n_known": np.zeros(len(ids), np.int64), "base": np.zeros(len(ids)), "score": np.zeros(len(ids))}
        parts = [r for r in rows if r["meta"] is None]
        for r in sorted(parts, key=lambda r: bytes(r["docs"]) + bytes(r["base"])):  # one order, whatever the shuffle's
            docs = unpack(r["docs"], np.uint32)
            for k, v in sums.items():
                v[docs] += unpack(r[k], {"n_known": np.uint32, "base": np.float64, "score": np.float32}[k])
        held, n = unpack(meta["held"], np.bool_), unpack(meta["n"], np.int64)
        return pa.table({"doc_id": pa.array(ids, mask=nulls), "held_out": held, "n_tokens": n, "n_known": sums["n_known"], "train_tokens": np.full(len(ids), known), "base_score": sums["base"], "score": sums["score"]})

    return parts.groupBy("chunk").applyInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def scores(spark: SparkSession, docs: DataFrame, *, sweeps: int = 3, kept: int = 2, theta: float = 1.0, theta1: float = 10.0, seed: int = 5, bits: int = CONTEXT_BITS, bucket_bytes: int = BUCKET) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs(doc_id, text).

    Learns from the rows whose crc32 of the doc_id's text leaves no remainder 1 by 5. Discounts are the usual estimate
    n1 / (n1 + 2 n2) of each level. A sweep takes out all customers of a dish in a restaurant and seats them again in
    turn, given everybody else (a block; no Metropolis step corrects the block's normaliser); the last `kept` sweeps'
    predictive probabilities are averaged for each token. Perplexity of a text: 10 ** (-score / n_tokens).

    Null and empty texts: one token, the end. Null doc_ids: their text is empty for the fold. Repeated rows: each
    teaches and is scored. No training rows: every word is unknown, the model is even. An empty table: no rows. Other
    columns are not looked at.
    """
    tmp = Scratch(spark, "pitman-yor")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("held", in_fold("doc_id", 5, 1))
    size = base.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    buckets = max(4, -(-size // bucket_bytes))
    hot = hot_words(base, buckets)
    state = tmp.keep(gather(deal(base, buckets, hot, bits), hot), "state")
    s = state.agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in ("known", "ones", "twos", "distinct", "root1", "root2")]).first()
    warm = hot_sums(state, "hot_c")
    discount = lambda a, b: min(max(a / (a + 2 * b), 0.1), 0.95) if a else 0.5
    shape = Shape(buckets, s["known"], s["distinct"] + sum(n > 0 for n in warm.values()), discount(s["ones"], s["twos"]), discount(s["root1"], s["root2"]), theta, theta1, by_block(state, bits), warm)
    # before the first sweep every pair sits at one table, as if its restaurant had a table for each
    now = Sample(np.minimum(shape.customers, 1), 1, 1, {w: (1, 1) for w in warm})
    seats, samples = Seats(tmp.path("seats")), {}
    for n in range(sweeps):
        shared = share(spark, shape, {n: now})
        swept = tmp.keep(sweep(state, seats, n, shared, seed * 1000 + n), f"sweep-{n}")
        shared.destroy()
        now = gathered(swept, shape, now, seed * 1000 + n, bits)
        tmp.drop(f"sweep-{n}", *([f"seats/{n - 1}"] if n and n - 1 < sweeps - kept else []))
        samples[n] = now
    shared = share(spark, shape, {n: samples[n] for n in list(samples)[-kept:]})
    return summed(partial_scores(state, seats, shared), shape.known)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, read(spark, sf_dir, "documents"))

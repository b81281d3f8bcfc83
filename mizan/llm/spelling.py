"""Spelling variants: every word's distance-one automaton meets broadcast trie shards (operator 12)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mizan.llm.common import Scratch, read
from mizan.llm.words import LOWER, buffers, filled, pieces

#: A run of letters is noisy if NOISE divides its hash; words have LETTERS code points and COUNT occurrences at least.
NOISE, LETTERS, COUNT = 199, 6, 5
#: A form is at least so many times as frequent as its variant.
RATIO = 5
#: Words of a trie shard at most, and bytes of the shards that are broadcast together.
SHARD_WORDS, GROUP_BYTES = 1 << 17, 64 << 20
#: Bytes of text whose words are counted together, and words that are looked up together.
PIECE, LOOKUPS = 8 << 20, 8_192

LEAD = 0xC3  # the UTF-8 lead byte of U+00C0 to U+00FF, all of which are in the alphabet
CRC = np.zeros(256, np.uint32)
for _i in range(256):
    _c = _i
    for _ in range(8):
        _c = (_c >> 1) ^ (0xEDB88320 if _c & 1 else 0)
    CRC[_i] = _c


def runs(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the maximal runs [A-Za-z\\u00C0-\\u00FF]+ of UTF-8 texts begin and end in data, texts beginning at at (and
    ending at its last). In UTF-8 the alphabet's second part is all that begins with one lead byte."""
    letter = (data - np.uint8(97) < 26) | (data - np.uint8(65) < 26) | (data == LEAD)
    letter[1:] |= data[:-1] == LEAD
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[at] = True
    first, last = letter.copy(), letter.copy()
    first[1:] &= ~letter[:-1] | edge[1:-1]
    last[:-1] &= ~letter[1:] | edge[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, state: np.ndarray) -> np.ndarray:
    """crc32 of prefix + run for each run; state: crc32 of the prefixes. Byte by byte over all runs at once; the few runs
    over 64 bytes one by one."""
    long = np.flatnonzero(ends - starts > 64)
    c = state ^ np.uint32(0xFFFFFFFF)
    order = np.argsort(starts - ends, kind="stable")  # longest first, so those that go on are a head
    length = (ends - starts)[order]
    live, at = c[order], starts[order]
    for j in range(min(int(length[0]) if len(length) else 0, 64)):
        k = np.searchsorted(-length, -j, side="left")  # runs longer than j
        live[:k] = CRC[(live[:k] ^ data[at[:k] + j]) & np.uint32(255)] ^ (live[:k] >> np.uint32(8))
    out = np.empty_like(c)
    out[order] = live ^ np.uint32(0xFFFFFFFF)
    for i in long:
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(state[i]))
    return out


def take(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """These parts of data as a binary array."""
    size = ends - starts
    to = np.concatenate([[0], np.cumsum(size)])
    flat = data[np.repeat(starts - to[:-1], size) + np.arange(to[-1])]
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(to.astype(np.int32)), pa.py_buffer(flat)])


def counted(ids: list[object], column: pa.Array) -> pa.StructArray:
    """Different words of texts and how often each occurs: lower-cased runs, noisy ones without one code point."""
    raw, at = buffers(column)
    data = LOWER[raw]
    starts, ends = runs(data, at)
    size = ends - starts - np.add.reduceat(np.append(data == LEAD, False).astype(np.int64), np.column_stack([starts, ends]).ravel())[::2] if len(starts) else ends - starts
    some = size >= LETTERS
    starts, ends, size = starts[some], ends[some], size[some]
    text = np.searchsorted(at, starts, side="right") - 1
    prefix = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    h = crcs(data, starts, ends, prefix[text]) if len(starts) else np.zeros(0, np.uint32)
    odd = h % NOISE == 0
    short = []
    for a, b, n, c in zip(starts[odd].tolist(), ends[odd].tolist(), size[odd].tolist(), h[odd].tolist(), strict=True):
        if n > LETTERS:  # one fewer code point still makes a word
            word = data[a:b].tobytes().decode()
            short.append((word[: c % n] + word[c % n + 1 :]).encode())
    words = pa.concat_arrays([take(data, starts[~odd], ends[~odd]), pa.array(short, pa.binary())])
    return words.value_counts()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filled(batches, "text", PIECE):
            for part in pieces(batch, "text", PIECE):
                found = counted(part.column("doc_id").to_pylist(), part.column("text"))
                for lo in range(0, len(found), 50_000):
                    some = found.slice(lo, 50_000)
                    yield pa.RecordBatch.from_arrays([some.field("values").cast(pa.string()), some.field("counts")], ["word", "n"])

    return docs.select("doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Trie:
    """Sorted words as a trie of arrays. Node 0 is the root; the children of a node lie together, by label.

    key: node * 256 + label of each node's edge, rising, so node i + 1 is what key[i] leads to; kids: where each node's
    children begin (and the end); word: the ordinal of the word that ends at a node, or -1; n: each word's count."""

    key: np.ndarray
    kids: np.ndarray
    word: np.ndarray
    n: np.ndarray

    @classmethod
    def of(cls, flat: np.ndarray, at: np.ndarray, n: np.ndarray) -> Trie:
        """From sorted different words of one byte a letter, one after another in flat."""
        size = np.diff(at)
        node = np.zeros(len(size), np.int64)  # where each word stands at this depth
        live = np.flatnonzero(size > 0)
        keys, ends, total, depth = [], np.zeros(0, np.int64), 1, 0
        place = np.zeros(len(size), np.int64)
        while len(live):
            key = node[live] * 256 + flat[at[live] + depth]
            new = np.ones(len(live), dtype=bool)
            new[1:] = key[1:] != key[:-1]
            keys.append(key[new])
            node[live] = total - 1 + np.cumsum(new)
            total += int(new.sum())
            depth += 1
            done = size[live] == depth
            place[live[done]] = node[live[done]]
            live = live[~done]
        key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        ends = np.full(total, -1, np.int32)
        ends[place] = np.arange(len(size))
        kids = np.searchsorted(key, np.arange(total + 1) * 256) + 1
        return cls(key, kids.astype(np.int32), ends, n)

    def step(self, node: np.ndarray, label: np.ndarray) -> np.ndarray:
        """The child of each node by its label, or -1."""
        want = node * 256 + label
        i = np.searchsorted(self.key, want)
        hit = i < len(self.key)
        hit[hit] = self.key[i[hit]] == want[hit]
        return np.where(hit, i + 1, -1)

    def children(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each child of each node: the place of its parent in node, and the child."""
        size = (self.kids[node + 1] - self.kids[node]).astype(np.int64)
        row = np.repeat(np.arange(len(node)), size)
        first = np.cumsum(size) - size
        return row, np.arange(len(row)) - first[row] + self.kids[node][row]

    def neighbours(self, flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) for each word of the trie at distance exactly one of each query.

        A query's automaton has states (letters read, edits made). The trie is walked along the letters read without an
        edit; at each of its nodes the edit's branches (a letter less, another, one more) are followed down to their end
        before the walk goes on, and a branch ends at the first letter that the trie hasn't. All queries walk at once."""
        size = np.diff(at)
        query, node, depth = np.arange(len(size)), np.zeros(len(size), np.int64), 0
        found = [np.zeros(0, np.int64)]
        while len(query):
            left = size[query] - depth
            row, child = self.children(node)
            label = self.key[child - 1] & 255
            own = np.full(len(query), -1, np.int64)
            own[left > 0] = flat[at[query[left > 0]] + depth]
            less, other = left > 0, (left[row] > 0) & (label != own[row])
            q = np.concatenate([query[less], query[row[other]], query[row]])
            v = np.concatenate([node[less], child[other], child])
            read = np.concatenate([np.full(less.sum() + other.sum(), depth + 1), np.full(len(row), depth)])
            while len(q):
                end = read == size[q]
                w = self.word[v[end]].astype(np.int64)
                found.append((q[end] * len(self.n) + w)[w >= 0])
                q, v, read = q[~end], v[~end], read[~end]
                v = self.step(v, flat[at[q] + read])
                q, v, read = q[v >= 0], v[v >= 0], read[v >= 0] + 1
            query, node, own = query[left > 0], node[left > 0], own[left > 0]
            node = self.step(node, own)
            query, node, depth = query[node >= 0], node[node >= 0], depth + 1
        pair = np.unique(np.concatenate(found))  # doubled letters are reached in several ways
        return pair // max(len(self.n), 1), pair % max(len(self.n), 1)


def letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words as one byte a letter (their code points are under 256), and where each begins (and the end)."""
    raw, at = buffers(words)
    lead = raw == LEAD
    flat = raw.copy()
    flat[1:][lead[:-1]] += 64  # U+00C0 to U+00FF: the lead byte, then code point - 64
    before = np.concatenate([[0], np.cumsum(lead)])
    return flat[~lead], at - before[at]


def shards(words: DataFrame, count: int, tmp: Scratch) -> DataFrame:
    """(shard, flat, sizes, counts, bytes) of so many words(word, n): each row the sorted words of one shard, near each
    other in order, SHARD_WORDS at most; bytes: of its trie, about."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).sort_by("word").combine_chunks()
            flat, at = letters(table["word"].chunk(0))
            blob = [flat.tobytes(), np.diff(at).astype("<u4").tobytes(), table["n"].to_numpy().astype("<i8").tobytes()]
            yield pa.RecordBatch.from_arrays([*[pa.array([x], pa.binary()) for x in blob], pa.array([16 * (len(flat) + len(at))])], ["flat", "sizes", "counts", "bytes"])

        for batch in batches:
            for lo in range(0, batch.num_rows, 1_000):
                held.append(batch.slice(lo, 1_000))
                if sum(x.num_rows for x in held) > SHARD_WORDS - 1_000:
                    yield from out()
                    held = []
        if held:
            yield from out()

    lots = 1 + count * 4 // (SHARD_WORDS * 3)
    ordered = words.repartitionByRange(lots, "word").coalesce(lots)
    cut = ordered.mapInArrow(run, "flat binary, sizes binary, counts binary, bytes long")
    return tmp.keep(cut.withColumn("shard", F.monotonically_increasing_id()), "shards")


#: The tries of the group that this worker used last, by the group's name.
_OPENED: dict[str, list[tuple[Trie, np.ndarray, np.ndarray]]] = {}


def opened(name: str, rows: list[dict]) -> list[tuple[Trie, np.ndarray, np.ndarray]]:
    """Of each shard its trie, its letters and where its words begin in them; a worker builds a group's tries once."""
    if name not in _OPENED:
        _OPENED.clear()
        made = []
        for row in rows:
            flat = np.frombuffer(row["flat"], np.uint8)
            at = np.concatenate([[0], np.cumsum(np.frombuffer(row["sizes"], "<u4"))]).astype(np.int64)
            made.append((Trie.of(flat, at, np.frombuffer(row["counts"], "<i8")), flat, at))
        _OPENED[name] = made
    return _OPENED[name]


def near(spark: SparkSession, words: DataFrame, count: int, tmp: Scratch) -> DataFrame:
    """(word, n, n_near, form, form_n) of so many words(word, n), form being the near word of largest n (ties: the
    smallest).

    Shards are broadcast in groups of GROUP_BYTES, a job each; in a group's job every word meets every one of its shards
    and hands on its count of near words and the best of them. What a task holds is the group and a batch.
    """
    table = shards(words, count, tmp)
    words = words.repartition(1 + count // (2 * LOOKUPS), "word")
    sizes = table.select("shard", "bytes").orderBy("shard").collect()  # a row for SHARD_WORDS words
    groups: list[list[int]] = [[]]
    room = GROUP_BYTES
    for r in sizes:
        if groups[-1] and r["bytes"] > room:
            groups.append([])
            room = GROUP_BYTES
        groups[-1].append(r["shard"])
        room -= r["bytes"]
    parts = [words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("string").alias("form"), F.lit(None).cast("long").alias("form_n"))]
    for k, group in enumerate(g for g in groups if g):
        sent = spark.sparkContext.broadcast([r.asDict() for r in table.filter(F.col("shard").isin(group)).collect()])  # GROUP_BYTES at most

        def run(batches: Iterator[pa.RecordBatch], sent=sent, name=tmp.path(f"near{k}")) -> Iterator[pa.RecordBatch]:
            tries = opened(name, sent.value)
            for batch in batches:
                for lo in range(0, batch.num_rows, LOOKUPS):
                    part = batch.slice(lo, LOOKUPS)
                    flat, at = letters(part.column(0))
                    for trie, own, own_at in tries:
                        q, w = trie.neighbours(flat, at)
                        if not len(q):
                            continue
                        order = np.lexsort((w, -trie.n[w], q))  # shards are sorted, so the least ordinal is the least word
                        q, w = q[order], w[order]
                        first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
                        best = w[first]
                        names = [own[own_at[i] : own_at[i + 1]].tobytes().decode("latin-1") for i in best.tolist()]
                        rows = pa.array(q[first])
                        yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), pa.array(np.diff(np.append(first, len(q)))), pa.array(names, pa.string()), pa.array(trie.n[best])], ["word", "n", "n_near", "form", "form_n"])

        parts.append(tmp.keep(words.mapInArrow(run, "word string, n long, n_near long, form string, form_n long"), f"near{k}"))
        sent.destroy()
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("less"), "form"))).alias("best")
    return every.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best).select("word", "n", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


def variants(spark: SparkSession, docs: DataFrame, *, least: int = COUNT, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of docs(doc_id, text).

    Null and empty texts have no words; a null doc_id counts as empty text in the hash of noise. Repeated rows count as
    often as they stand. Very long texts and runs are taken whole. Ties among near words: the smallest by code points.
    A form is at least `ratio` times as frequent as its variant, so forms rise and end: following them doubles the way
    each round, and there are no more rounds than the logarithm of the longest way. Words without a form are their own
    root. An empty table: no rows. Other columns are not looked at.
    """
    tmp = Scratch(spark, "spelling")
    words, seen = tmp.observed(word_counts(docs).filter(F.col("n") >= least), "words", F.count("*").alias("n"))
    known = near(spark, words, seen["n"], tmp)
    fits = F.col("form_n") >= ratio * F.col("n")
    known = tmp.keep(known.select("word", "n", "n_near", F.when(fits, F.col("form")).alias("form"), F.when(fits, F.col("form_n")).alias("form_n")), "known")
    way = tmp.keep(known.filter("form is not null").select("word", F.col("form").alias("root")), "way0")
    k = 0
    while True:
        k += 1
        ahead = way.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = way.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        stepped, seen = tmp.observed(stepped, f"way{k}", F.count(F.when(F.col("moved"), 1)).alias("moved"))
        way = stepped.select("word", "root")
        if not seen["moved"]:
            break
    tmp.drop("shards")
    return known.join(way, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark, read(spark, sf_dir, "documents"))


#: crc32 goes byte by byte through its table; letters from U+00C0 on are two bytes.
OP12_SQL = f"""
WITH RECURSIVE tab AS (SELECT {[int(x) for x in CRC]} AS t),
r AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS x FROM documents),
l AS (SELECT doc_id, translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x, count(*) AS n FROM r WHERE length(x) >= {LETTERS} GROUP BY 1, 2),
b AS (SELECT x, n, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || x, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [CAST({LEAD} AS BIGINT), unicode(c) - 64] END)) AS bytes FROM l),
h AS (SELECT x, n, xor(list_reduce(bytes, lambda c, y: xor(t[CAST(xor(c, y) & 255 AS INT) + 1], c >> 8), 4294967295), 4294967295) AS h FROM b, tab),
e AS (SELECT CASE WHEN h % {NOISE} = 0 THEN substr(x, 1, CAST(h % length(x) AS BIGINT)) || substr(x, CAST(h % length(x) AS BIGINT) + 2) ELSE x END AS word, n FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM e WHERE length(word) >= {LETTERS} GROUP BY 1 HAVING sum(n) >= {COUNT}),
d AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
one AS (SELECT DISTINCT d.word AS a, w.word AS b FROM d JOIN w ON w.word = d.less),
p AS (SELECT a, b FROM one UNION SELECT b, a FROM one UNION SELECT x.word, y.word FROM d x JOIN d y ON x.less = y.less AND x.i = y.i AND x.word <> y.word),
k AS (SELECT a AS word, count(*) AS n_near, arg_min(b, {{'less': -w.n, 'b': b}}) AS best FROM p JOIN w ON w.word = b GROUP BY 1),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN z.n >= {RATIO} * w.n THEN best END AS form, CASE WHEN z.n >= {RATIO} * w.n THEN z.n END AS form_n FROM w LEFT JOIN k ON k.word = w.word LEFT JOIN w z ON z.word = best),
c AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT c.word, f.word, f.form FROM c JOIN f ON f.word = c.next)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN c ON c.word = f.word AND c.next IS NULL
"""

"""Words and word shingles of whole Arrow string columns, as numpy arrays of 64-bit hashes.

A word is a longest run of bytes other than space and \\t \\n \\v \\f \\r, with A-Z lower-cased. All of it is array
arithmetic over the column's bytes: words are hashed block by block, all at once, so no Python loop runs per usual word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True

U = np.uint64
BASE = 0x9E3779B97F4A7C15
#: Bytes of a word that are mixed in eight at a time; a longer word is hashed by BLAKE2b.
SHORT = 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (Stafford's variant 13)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * U(BASE))


@dataclass
class Words:
    """data: lower-cased bytes of all texts; text_at: where each text begins (and the end); starts, ends, hashes: of each
    word; first: index of each text's first word (and the number of words)."""

    data: np.ndarray
    text_at: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    prefixes: dict[int, np.ndarray]

    @property
    def text_of(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes, and where each text begins in them (and the end); a null is an empty text."""
    if column.null_count:
        column = pa.compute.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about limit bytes of text; a longer text is a slice of its own."""
    _, at = buffers(batch.column(batch.schema.get_field_index(column)))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1)
        yield batch.slice(i, min(j, n) - i)
        i = min(j, n)


def filled(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The batches, small ones put together until they hold about limit bytes of text."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        more = int(buffers(batch.column(batch.schema.get_field_index(column)))[1][-1])
        if held and size + more > limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        if batch.num_rows:
            held.append(batch)
            size += more
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def words(column: pa.Array, prefixes: tuple[int, ...] = ()) -> Words:
    """Words of a string column; prefixes: also hash the first so many bytes, eight at most, of each word (0 where a word is
    shorter)."""
    raw, at = buffers(column)
    return scan(LOWER[raw], at, prefixes)


def boundaries(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of texts begin and end in data, texts beginning at at (and ending at its last)."""
    solid = ~IS_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[at] = True
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last[:-1] &= ~solid[1:] | edge[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def scan(data: np.ndarray, at: np.ndarray, prefixes: tuple[int, ...] = ()) -> Words:
    """Words of texts that begin at at (and end at its last) in the bytes data.

    A word's eight-byte blocks go one after another through mix(), so no sum or polynomial of its bytes is left that two
    words could share; words over SHORT bytes take 64 bits of BLAKE2b. Prefixes have eight bytes at most."""
    starts, ends = boundaries(data, at)
    padded = np.concatenate([data, np.zeros(SHORT, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    length = ends - starts

    def block(place: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The first `left` of eight bytes."""
        return eight[place] & (U(0xFFFFFFFFFFFFFFFF) >> (U(64) - U(8) * np.clip(left, 1, 8).astype(np.uint64)))

    hashes = mix(length.astype(np.uint64) * U(BASE))
    for j in range(0, SHORT, 8):
        some = np.flatnonzero(length > j) if j else slice(None)
        hashes[some] = mix((hashes[some] ^ block(starts[some] + j, length[some] - j)) * U(BASE))
    for i in np.flatnonzero(length > SHORT):
        hashes[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    heads = {k: np.where(length >= k, mix(block(starts, np.full(len(starts), k)) ^ mix(np.full(len(starts), k, np.uint64))), U(0)) for k in prefixes}
    return Words(data, at, starts, ends, hashes, np.searchsorted(starts, at), heads)


def window_hashes(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of size words within a text, in order, and where each text's runs begin (and the end). A text
    with fewer words, but at least one, has its whole sequence as its one run."""
    count = np.diff(w.first)
    runs = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    at = np.concatenate([[0], np.cumsum(runs)])
    out = np.empty(at[-1], np.uint64)
    text = np.repeat(np.arange(len(count)), runs)
    begin = w.first[:-1][text] + (np.arange(at[-1]) - at[:-1][text])
    value = np.zeros(at[-1], np.uint64)
    left = np.minimum(count[text], size)
    for j in range(size):
        here = j < left
        step = np.where(here, w.hashes[np.minimum(begin + j, max(len(w.hashes) - 1, 0))], U(0)) if len(w.hashes) else np.zeros(0, np.uint64)
        value = value * U(BASE) + step
    out[:] = mix(value ^ left.astype(np.uint64))
    return out, at


def shingle_sets(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs of size words of each text, sorted, one text after another, and where each text's begin (and the end)."""
    value, at = window_hashes(w, size)
    for i in range(len(at) - 1):
        value[at[i] : at[i + 1]].sort()
    new = np.ones(len(value), dtype=bool)
    new[1:] = value[1:] != value[:-1]
    new[at[:-1][at[:-1] < len(value)]] = True
    total = np.concatenate([[0], np.cumsum(new)])
    return value[new], total[at]

"""Token-ID output: Arrow IPC files of equal-length sequences and masks (operator 1)."""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mizan.llm.common import Scratch, read
from mizan.llm.words import IS_SPACE, boundaries, buffers, filled, pieces

#: Ids of a sequence, and sequences of a record batch.
LENGTH, BATCH = 2048, 64
#: Bytes of text whose different words are encoded together.
PIECE = 2 << 20

#: The tokenizer file's normalizer and splitting pattern with which a text's ids are those of its words.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
#: Bytes of ASCII letters, of other ASCII marks but the apostrophe, and small letters.
LETTER_BYTE = np.zeros(256, bool)
LETTER_BYTE[[*range(65, 91), *range(97, 123), 0xC3]] = True
MARK_BYTE = np.zeros(256, bool)
MARK_BYTE[[i for i in range(33, 127) if not chr(i).isalnum() and chr(i) != "'"]] = True
SMALL = np.arange(256, dtype=np.uint8)
SMALL[65:91] += 32
#: A word of its own between words that are encoded together.
MARK = "\x01"


def ragged(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the items of rows stand in a list column that begins at at, and where each row's begin in the result."""
    size = at[rows + 1] - at[rows]
    to = np.concatenate([[0], np.cumsum(size)])
    flat = np.repeat((at[rows] - to[:-1]).astype(np.int32), size)  # a piece has far fewer than 2**31 items
    flat += np.arange(to[-1], dtype=np.int32)
    return flat, to


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.StringArray:
    """These parts of UTF-8 bytes as a string array."""
    size = ends - starts
    to = np.concatenate([[0], np.cumsum(size)])
    flat = data[np.repeat(starts - to[:-1], size) + np.arange(to[-1])]
    return pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(to.astype(np.int32)), pa.py_buffer(flat)])


def lots(words: pa.StringArray, between: str, size: int = 1024) -> list[str]:
    """The words, so many in a text, with what stands between them."""
    at = np.append(np.arange(0, len(words), size), len(words)).astype(np.int32)
    return pa.compute.binary_join(pa.ListArray.from_arrays(pa.array(at), words), between).to_pylist()


class Encoder:
    """Ids of whole texts by a tokenizer file.

    White space parts words for the usual word-BPE file, and neither normalizing, splitting nor merging looks across it.
    So the library encodes each different word of a column once, and texts are put together from their words' ids; tests
    hold this against encoding whole texts. Words of letters, and the marks behind them, are encoded apart, as the
    splitting pattern parts them; such words go without the normalizer, in small letters. Files of another kind, and words
    that hold the mark, are encoded as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        part = lambda x: json.loads(x.__getstate__()) if x else None
        steps = (part(self.library.pre_tokenizer) or {}).get("pretokenizers", [])
        usual = part(self.library.normalizer) == NORMALIZER and len(steps) == 2 and steps[0].get("pattern") == {"Regex": PATTERN}
        usual = usual and steps[1]["type"] == "ByteLevel" and not steps[1]["use_regex"] and self.library.model.end_of_word_suffix == WORD_END
        added = self.library.get_added_tokens_decoder()
        self.size = max(self.library.get_vocab_size(), max(added, default=-1) + 1)
        mark = self.library.encode(MARK, add_special_tokens=False).ids
        self.by_words = usual and len(mark) == 1 and not any(set(t.content) & set(" \t\n\v\f\r") for t in added.values())
        self.mark = mark[0] if mark else -1
        self.ends = np.array([(self.library.id_to_token(i) or "").endswith(WORD_END) for i in range(self.size)], bool)
        # the same model for words of small letters alone, which the normalizer leaves as they are and the pattern as one piece
        self.plain = Tokenizer(self.library.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def _texts(self, texts: list[str], library: object = None) -> tuple[np.ndarray, np.ndarray]:
        code = library or self.library
        # a few texts at once: the library's own encodings take far more room than ids
        ids = [np.array(x.ids, np.uint32) for i in range(0, len(texts), 8) for x in code.encode_batch_fast(texts[i : i + 8], add_special_tokens=False)]
        at = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
        return np.concatenate(ids or [np.zeros(0, np.uint32)]), at

    def _parts(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """How many bytes of letters each word begins with, and whether other ASCII marks alone follow them (or nothing).

        Letters are A-Z and those of U+00C0 to U+00FF, none of which a normal form changes; the apostrophe is no mark
        here, since the pattern joins letters to it."""
        raw, at = buffers(words)
        letter = LETTER_BYTE[raw]
        lead = raw == 0xC3
        letter[1:][lead[:-1]] = ~np.isin(raw[1:][lead[:-1]], (0x97, 0xB7))  # the signs of times and division
        letter[:-1][lead[:-1]] &= letter[1:][lead[:-1]]
        begin, end = at[:-1], at[1:]
        before = np.concatenate([[0], np.cumsum(letter)])
        marks = np.concatenate([[0], np.cumsum(MARK_BYTE[raw])])
        again = np.concatenate([[False], letter[1:] & ~letter[:-1], [False]])
        again[begin] = False  # a word's first letter
        turns = np.concatenate([[0], np.cumsum(again[:-1])])
        size = before[end] - before[begin]
        simple = (size > 0) & letter[np.minimum(begin, max(len(raw) - 1, 0))] & (size + marks[end] - marks[begin] == end - begin) & (turns[end] == turns[begin])
        return size, simple

    def _words(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word. Letters at its head (one piece, so one id that ends it) and the marks that follow are two
        items; any other word is one. Each different item is encoded once."""
        raw, at = buffers(words)
        size, simple = self._parts(words)
        odd = pa.compute.match_substring(words, MARK).to_numpy(zero_copy_only=False).astype(bool)
        low = SMALL[raw]
        low[1:][(raw[:-1] == 0xC3) & (raw[1:] < 0x9F)] += 0x20
        mid = at[:-1] + size
        heads = strings(low, at[:-1][simple], mid[simple]).dictionary_encode()
        tailed = simple & (mid < at[1:])
        rest = np.where(tailed, mid, at[:-1])
        others_of = ~simple & ~odd | tailed
        others = strings(raw, rest[others_of], at[1:][others_of]).dictionary_encode()
        letters = self._texts(lots(heads.dictionary, " "), self.plain)[0]
        letters_at = np.concatenate([[0], np.flatnonzero(self.ends[letters]) + 1])
        other = self._texts([f"{x} {MARK} " for x in lots(others.dictionary, f" {MARK} ")])[0]
        marks = np.flatnonzero(other == self.mark)
        other, other_at = np.delete(other, marks), np.concatenate([[0], marks - np.arange(len(marks))])
        whole, whole_at = self._texts(words.filter(pa.array(odd)).to_pylist())
        h, o = len(heads.dictionary), len(others.dictionary)
        assert len(letters_at) == h + 1 and len(other_at) == o + 1, "a word's ids were not told apart"
        ids = np.concatenate([letters, other, whole])
        at = np.concatenate([letters_at, other_at[1:] + len(letters), whole_at[1:] + len(letters) + len(other)])
        items = np.full((len(words), 2), -1, np.int64)
        items[simple, 0] = heads.indices.to_numpy()
        items[odd & ~simple, 0] = h + o + np.arange((odd & ~simple).sum())
        items[others_of, 1] = h + others.indices.to_numpy()
        every = items.ravel()
        flat, to = ragged(at, every[every >= 0])
        return ids[flat], to[np.concatenate([[0], np.cumsum((items >= 0).sum(axis=1))])]

    def encode(self, column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each text and its end id, one text after another, and where each text's begin (and the end)."""
        raw, text_at = buffers(column)
        n = len(text_at) - 1
        if not self.by_words:
            ids, at = self._texts(["" if t is None else t for t in column.to_pylist()])
            return self._closed(ids, at, np.arange(n), np.arange(n + 1), end)
        starts, ends = boundaries(raw, text_at)
        at = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
        solid = np.ascontiguousarray(raw[~IS_SPACE[raw]])
        every = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(solid)]).dictionary_encode()
        ids, at = self._words(every.dictionary)
        return self._closed(ids, at, every.indices.to_numpy().astype(np.int64), np.searchsorted(starts, text_at), end)

    @staticmethod
    def _closed(ids: np.ndarray, at: np.ndarray, rows: np.ndarray, row_at: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Texts from items: item rows[row_at[i]:row_at[i + 1]] and then end make text i."""
        n = len(row_at) - 1
        ids, at = np.append(ids, np.uint32(end)), np.append(at, at[-1] + 1)
        every = np.insert(rows, row_at[1:], len(at) - 2)
        flat, to = ragged(at, every)
        return ids[flat], to[row_at + np.arange(n + 1)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _schema(kind: pa.DataType, length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.field("item", kind, nullable=False), length)), ("mask", pa.list_(pa.field("item", pa.bool_(), nullable=False), length))])


def write(spark: SparkSession, docs: DataFrame, tokenizer: str, root: str, *, end: int = 2, length: int = LENGTH) -> None:
    """Write ids of docs(doc_id, text) under root, as shards in ascending doc_id order.

    A shard is two Arrow IPC files: ids-N.arrow holds record batches of (ids, mask), both fixed-size lists of `length`,
    uncompressed, so that a reader maps the file and takes sequence i of a batch without copying; the mask is false
    where the shard's last sequence is filled up. docs-N.arrow holds doc_id, start (in the shard) and n_tokens of each
    document. Ids are 16-bit where the vocabulary allows it, else 32-bit.

    Tasks write to a name of their own and rename at the end, so a task that is tried again does no harm; no file holds
    more than a partition of the range shuffle, and no task more than a batch.
    Null and empty texts: the end id alone. Null doc_ids come first. Rows with equal doc_ids: all are written, by text.
    An empty table: no shards. Further columns are not looked at.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        kind = pa.uint16() if code.size <= 1 << 16 else pa.uint32()
        shard = TaskContext.get().partitionId()
        fs, at = pa.fs.FileSystem.from_uri(root)
        mine = f"{at}/.{shard}-{uuid.uuid4().hex}"
        sequences = rows = None
        left, done = np.zeros(0, kind.to_pandas_dtype()), 0

        def put(ids: np.ndarray, real: int) -> None:
            lists = pa.FixedSizeListArray.from_arrays(pa.array(ids), length)
            mask = pa.FixedSizeListArray.from_arrays(pa.array(np.arange(len(ids)) < real), length)
            sequences.write_batch(pa.RecordBatch.from_arrays([lists.cast(_schema(kind, length).field("ids").type), mask.cast(_schema(kind, length).field("mask").type)], schema=_schema(kind, length)))

        for batch in filled(batches, "text", PIECE):
            for part in pieces(batch, "text", PIECE):
                if sequences is None:
                    sequences = pa.ipc.new_file(f1 := fs.open_output_stream(f"{mine}-ids"), _schema(kind, length))
                    rows = pa.ipc.new_file(f2 := fs.open_output_stream(f"{mine}-docs"), pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())]))
                ids, to = code.encode(part.column("text"), end)
                rows.write_batch(pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(to[:-1] + done), pa.array(np.diff(to))], names=["doc_id", "start", "n_tokens"]))
                done += int(to[-1])
                left = np.concatenate([left, ids.astype(left.dtype)])
                while len(left) >= length * BATCH:
                    put(left[: length * BATCH], length * BATCH)
                    left = left[length * BATCH :]
        if sequences is not None:
            if len(left):
                full = np.zeros(-(-len(left) // length) * length, left.dtype)
                full[: len(left)] = left
                put(full, len(left))
            for x in (sequences, rows, f1, f2):
                x.close()
            fs.move(f"{mine}-docs", f"{at}/docs-{shard:06d}.arrow")
            fs.move(f"{mine}-ids", f"{at}/ids-{shard:06d}.arrow")
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([done], pa.int64())], ["shard", "n_tokens"])

    fs, at = pa.fs.FileSystem.from_uri(root)
    fs.create_dir(at, recursive=True)
    shards = ordered.mapInArrow(run, "shard int, n_tokens long")
    shards.write.parquet(f"{root}/shards")


def open_shard(root: str, shard: int) -> tuple[pa.ipc.RecordBatchFileReader, pa.Table]:
    """A shard's reader of (ids, mask) batches, mapped where the store is a local one, and its documents."""
    fs, at = pa.fs.FileSystem.from_uri(root)
    local = isinstance(fs, pa.fs.LocalFileSystem)
    take = pa.memory_map if local else fs.open_input_file
    with fs.open_input_file(f"{at}/docs-{shard:06d}.arrow") as f:
        rows = pa.ipc.open_file(f).read_all()
    return pa.ipc.open_file(take(f"{at}/ids-{shard:06d}.arrow")), rows


def digests(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, shard) of every document, from the files alone; start counts the ids of all
    documents before it in all shards. crc32 is over the ids as little-endian unsigned 32-bit integers."""
    shards = spark.read.schema("shard int, n_tokens long").parquet(f"{root}/shards")
    ahead = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    based = shards.select("shard", F.coalesce(F.sum("n_tokens").over(ahead), F.lit(0)).alias("base"))
    lots = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, base in zip(batch.column("shard").to_pylist(), batch.column("base").to_pylist(), strict=True):
                reader, rows = open_shard(root, shard)
                ends = (rows["start"].to_numpy() + rows["n_tokens"].to_numpy()).tolist()
                crcs = np.zeros(len(ends), np.int64)
                doc, place, crc = 0, 0, 0
                for i in range(reader.num_record_batches):
                    got = reader.get_batch(i)
                    ids = got.column("ids").values.to_numpy().astype("<u4")[got.column("mask").values.to_numpy(zero_copy_only=False)]
                    used = 0
                    while doc < len(ends) and ends[doc] <= place + len(ids):
                        crcs[doc] = zlib.crc32(ids[used : ends[doc] - place].tobytes(), crc)
                        used, crc = ends[doc] - place, 0
                        doc += 1
                    crc = zlib.crc32(ids[used:].tobytes(), crc)
                    place += len(ids)
                assert doc == len(ends), "the shard holds fewer ids than its documents"
                for lo in range(0, len(ends), 10_000):
                    some = rows.slice(lo, 10_000).combine_chunks()
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (some["doc_id"].combine_chunks(), pa.compute.add(some["start"], base).combine_chunks(), some["n_tokens"].combine_chunks(), crcs[lo : lo + 10_000], np.full(some.num_rows, shard, np.int32))], ["doc_id", "start", "n_tokens", "ids_crc32", "shard"])

    return based.repartition(lots).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int")


def output(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Write docs with the word-BPE file and digest what was written; the files stay in the shared folder."""
    import public_tokenizers

    root = Scratch(spark, "tokens").path("arrow")
    write(spark, docs, public_tokenizers.path("word_bpe_49k.json"), root)
    return digests(spark, root)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return output(spark, read(spark, sf_dir, "documents"))

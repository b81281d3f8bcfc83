"""Operator 13 against pieces cut one by one from whole texts encoded by the library."""

import zlib

import numpy as np
import public_tokenizers
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from mizan.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@given(st.lists(st.integers(1, 9_000), max_size=20))
def test_cuts_are_binary_digits(sizes):
    doc, start, size = packing.cuts(np.array(sizes, np.int64))
    for i, n in enumerate(sizes):
        mine = size[doc == i].tolist()
        assert sum(mine) == n and mine == sorted(mine, reverse=True)
        assert all(x & (x - 1) == 0 and x <= 2048 for x in mine)
        assert len({x for x in mine if x < 2048}) == len([x for x in mine if x < 2048])
        assert start[doc == i].tolist() == [sum(mine[:k]) for k in range(len(mine))]


def test_pack_equals_brute_force(spark, tmp_path):
    rows = [(1, "one two three"), (2, None), (3, ""), (4, "word and more " * 3_000), (5, "a b"), (5, "a b"), (None, "née été !?"), (6, "  \n\t "), (7, "x" * 10_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'k' length", "1 ids", "2 task", "3 n").repartition(3)
    got = packing.pack(spark, docs, PATH, f"file://{tmp_path}/p").collect()
    library = Tokenizer.from_file(PATH)
    want = []
    for doc_id, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        at = 0
        while at < len(ids):
            n = min(2048, 1 << ((len(ids) - at).bit_length() - 1))
            want.append((str(doc_id), at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes()), len(ids)))
            at += n
    assert sorted(want) == sorted((str(r.doc_id), r.start, r.length, zlib.crc32(r.ids), r.doc_tokens) for r in got)
    ordered = sorted(got, key=lambda r: r.sequence_id)
    assert [r.sequence_id for r in ordered] == list(range(len(want)))
    assert [r.length for r in ordered] == sorted((r.length for r in got), reverse=True)


def test_pack_of_no_rows(spark, tmp_path):
    assert packing.pack(spark, spark.createDataFrame([], "doc_id long, text string"), PATH, f"file://{tmp_path}/p").collect() == []

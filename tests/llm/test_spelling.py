"""Operator 12 against a brute-force version of its definition."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st

from mizan.llm import spelling
from mizan.llm.common import read
from tests.compare import SF_DIR

RUN = re.compile("[A-Za-zÀ-ÿ]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def counts(rows):
    found = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += len(run) >= 6
    return {w: n for w, n in found.items() if n >= 5}


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def brute(rows):
    known = counts(rows)
    by_part = {}
    for w in known:  # words one apart share a half: nothing is lost, and far fewer pairs are compared
        for half in {("a", w[: len(w) // 2]), ("a", w[: (len(w) - 1) // 2]), ("a", w[: (len(w) + 1) // 2]), ("b", w[len(w) // 2 :]), ("b", w[(len(w) + 1) // 2 :]), ("b", w[(len(w) - 1) // 2 :])}:
            by_part.setdefault(half, []).append(w)
    pairs = {(a, b) for some in by_part.values() for a in some for b in some if one_apart(a, b)}
    near = {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
    form = {w: min(near[w], key=lambda x: (-known[x], x)) for w in near}
    form = {w: f for w, f in form.items() if known[f] >= 5 * known[w]}
    out = []
    for w, n in known.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near.get(w, [])), known.get(form.get(w))))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def test_given_documents(spark):
    docs = read(spark, SF_DIR, "documents")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert len(want) > 100 and rows_of(spelling.variants(spark, docs)) == want


def test_made_words(spark, monkeypatch):
    letters = "aé"
    g = np.random.default_rng(5)
    words = ["".join(letters[i] for i in g.integers(0, 2, g.integers(6, 9))) for _ in range(150)]
    texts = [(i, " ".join(g.choice(words, 400, p=(w := 1 / np.arange(1, 151) ** 1.6) / w.sum()))) for i in range(40)]
    rows = [*texts, (1, None), (2, ""), (None, "x" * 70_000 + " " + " ".join(["ÀÉabcdé", "ÀÉabcdÉ"] * 6)), (3, ("y" * 3_000 + " ") * 6), (3, ("y" * 3_000 + " ") * 6), (7, "日本abcdefg日" * 8), (8, "ÿ×÷øéabc " * 9)]
    monkeypatch.setattr(spelling, "GROUP_BYTES", 1_000)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 word", "2 n", "3 root").repartition(3)
    got = rows_of(spelling.variants(spark, docs))
    assert got == brute(rows) and max(r[4] for r in got) > 3 and any(r[1] and r[1] != r[2] for r in got)


def test_no_rows(spark):
    assert spelling.variants(spark, spark.createDataFrame([], "doc_id long, text string")).collect() == []


WORD = st.text("abé", min_size=1, max_size=7)


@given(st.sets(WORD, min_size=1, max_size=40), st.lists(WORD, min_size=1, max_size=10))
def test_neighbours_are_all_at_distance_one(words, queries):
    order = sorted(words)
    flat, at = spelling.letters(pa.array(order))
    trie = spelling.Trie.of(flat, at, np.ones(len(order), np.int64))
    q, w = trie.neighbours(*spelling.letters(pa.array(queries)))
    assert sorted(zip(q.tolist(), w.tolist(), strict=True)) == [(i, j) for i, a in enumerate(queries) for j, b in enumerate(order) if one_apart(a, b)]


@given(st.lists(st.text("aB é×-中", max_size=90), max_size=6))
def test_counts(texts):
    ids = list(range(len(texts)))
    got = {r["values"].decode(): r["counts"] for r in spelling.counted(ids, pa.array(texts, pa.string())).to_pylist()}
    want = Counter()
    for i, t in zip(ids, texts, strict=True):
        for run in RUN.findall(t):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{i}:{run}".encode())
            run = run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]
            want[run] += len(run) >= 6
    assert got == {w: n for w, n in want.items() if n}

"""Texts made to deceive hashes, and groups of near copies that no single member links."""

import random
import zlib

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import public_tokenizers
from mizan.llm import neardup, tokens
from mizan.llm.words import scan, words

DOCS = "doc_id long, text string"


def morse(n):
    """The Thue-Morse word of two letters, and its complement: equal under every polynomial hash modulo 2**64."""
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s, s.translate(str.maketrans("ab", "ba"))


def test_hash_tells_thue_morse_words_apart():
    for n in (4, 8, 16, 32, 64, 1024, 2048, 4096):
        a, b = words(pa.array(list(morse(n)))).hashes
        assert a != b, n


def test_words_of_any_length_keep_their_own_hash():
    rng = random.Random(7)
    some = list(dict.fromkeys("".join(rng.choice("ab") for _ in range(rng.randrange(1, 70))) for _ in range(3000)))
    h = words(pa.array([" ".join(some), *some])).hashes
    assert len(set(h[: len(some)].tolist())) == len(some) and (h[: len(some)] == h[len(some) :]).all()


def test_prefixes():
    import numpy as np

    data = np.frombuffer(b"insulting insult ins", np.uint8)
    w = scan(data, np.array([0, len(data)]), (4, 6))
    assert w.prefixes[4][0] == w.prefixes[4][1] != 0 and w.prefixes[6][0] == w.prefixes[6][1] != 0 and w.prefixes[4][2] == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_the_librarys(name):
    rng = random.Random(2)
    texts = [*morse(2048), "a\x01b \x01 c\x01", "<|endoftext|>x y<|startoftext|> z", None, "", " \n", "don't DON'T 'S x's 12,34", "İI ΣΑΣ a b ́x"]
    texts += ["".join(rng.choice(" \t\n\x01aB'sé́ßΣ1½.,-😀‍") for _ in range(rng.randrange(60))) for _ in range(500)]
    library = Tokenizer.from_file(public_tokenizers.path(name))
    ids, at = tokens.Encoder(public_tokenizers.path(name)).encode(pa.array(texts), 2)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == [*library.encode(t or "", add_special_tokens=False).ids, 2], t


def test_thue_morse_documents(spark):
    a, b = morse(2048)
    docs = spark.createDataFrame([(1, a), (2, b), (3, a + " p q"), (4, b + " p q")], DOCS)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r["doc_id"]: r["ids_crc32"] for r in tokens.output(spark, docs).collect()}
    for i, t in ((1, a), (2, b)):
        assert got[i] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in [*library.encode(t, add_special_tokens=False).ids, 2]))
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark, docs, shingle=3, threshold=85).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}


def components_of(texts, k, threshold):
    """Brute force on real shingles."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in texts:
        for b in texts:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}


@pytest.mark.parametrize("fresh", [True, False])
def test_near_copies_around_a_base(spark, fresh):
    """Edits of one base, many of them too far from it: with words of their own, or with words that others use too."""
    rng = random.Random(11)
    base = [f"b{i}" for i in range(70)]
    texts = {}
    for i in range(120):
        w = list(base)
        for place in rng.sample(range(70), rng.randrange(6)):
            w[place] = f"w{i}-{place}" if fresh else f"w{place % 3}"
        texts[i] = " ".join(w)
    chain = [f"c{i}" for i in range(60)]  # each near the next alone
    for i in range(20):
        texts[200 + i] = " ".join(chain[i:] + [f"d{j}" for j in range(i)])
    got = neardup.near_duplicates(spark, spark.createDataFrame(list(texts.items()), DOCS).repartition(5), shingle=3, threshold=85)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == components_of(texts, 3, 85)


def test_repeated_and_null_ids(spark):
    one, two = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(5, one), (5, two), (3, one), (9, two + " c"), (5, one), (None, one), (7, None), (7, "")]
    got = [(r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(spark, spark.createDataFrame(rows, DOCS)).collect()]
    assert sorted(got, key=str) == sorted([(5, 3, False)] * 3 + [(3, 3, True), (9, 3, False), (None, None, True), (7, 7, True), (7, 7, True)], key=str)

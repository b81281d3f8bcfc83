"""Operators held against plain versions on small tables with nulls, empty texts, copies and clashing columns."""

import collections
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from mizan.llm import chat, fingerprint, mixing, neardup, pitman_yor, sharding, tokens, urls
from mizan.llm.decontam import with_leaks

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base = [" ".join(rng.choice(["red", "Blue", "sea", "tree", "old", "fox", "été", "stone"]) + str(rng.randrange(9)) for _ in range(rng.randrange(3, 60))) for _ in range(20)]
    out = dict(enumerate(base))
    for i in range(20, 40):
        w = base[i % 20].split()
        w[rng.randrange(len(w))] = "changed"
        out[i] = " ".join(w)
    return out | {40: None, 41: "", 42: " \t\n", 43: "one", 44: "ONE", 45: base[0], 46: "x " * 3000}


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s1", 0, 1) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n long, score int").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_near_duplicates(spark, docs, none, texts):
    sets = {}
    for i, t in texts.items():
        w = words(t)
        sets[i] = {tuple(w[j : j + 3]) for j in range(len(w) - 2)} or ({tuple(w)} if w else set())
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in texts:
        for b in texts:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r["doc_id"]: r for r in neardup.near_duplicates(spark, docs, shingle=3, threshold=85).collect()}
    assert {i: (r["component_id"], r["n_shingles"], r["kept"]) for i, r in got.items()} == {i: (find(i), len(sets[i]), find(i) == i) for i in texts}
    assert neardup.near_duplicates(spark, none).count() == 0


def test_lm_scores(spark, docs, none, texts):
    tokens_ = {i: [*words(t), "\0end"] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    c = collections.Counter(w for i, t in tokens_.items() if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    got = {r["doc_id"]: r for r in pitman_yor.scores(spark, docs, bucket_bytes=2000).collect()}
    for i, t in tokens_.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), rel_tol=1e-9)
        assert -math.inf < r["score"] < 0
    assert sum(r["score"] for r in got.values()) > sum(r["base_score"] for r in got.values())
    assert pitman_yor.scores(spark, none).count() == 0


def test_seating_follows_the_rule():
    import numpy as np

    rng = np.random.default_rng(1)
    many = 20_000
    k = pitman_yor.seat(np.full(many, 3), 0.5, 1.0, np.zeros(many), np.full(many, 0.4), rng)
    p2 = (1 + 0.5) * 0.4 / ((1 + 0.5) * 0.4 + 0.5)  # the second customer's chance of a new table
    assert abs((k >= 2).mean() - (p2 + (1 - p2) * 0.6 / (0.6 + 1.5))) < 0.02
    assert (pitman_yor.seat(np.full(9, 10**6), 0.5, 1.0, np.zeros(9), np.full(9, 1e-9), rng) < 5).all()


def test_sharding(spark, docs, none, texts):
    rows = sharding.shard(spark, docs, 4).collect()
    assert {r["doc_id"]: r["size"] for r in rows} == {i: len((t or "").encode()) + 1 for i, t in texts.items()}
    for s in range(4):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard(spark, none, 4).count() == 0


def test_fingerprints(spark, docs, none, texts):
    got = {r["doc_id"]: r for r in fingerprint.compare(spark, docs).collect()}
    assert got[0]["fingerprint"] == got[45]["fingerprint"] and got[0]["fingerprint"] != got[1]["fingerprint"]
    assert all(got[i]["n_chars"] == len(t or "") and 0 <= got[i]["near_edited"] <= 1 for i, t in texts.items())
    a, b = fingerprint.fingerprints(["p\nq\nr"]), fingerprint.fingerprints(["r\np"])
    assert (a - fingerprint.fingerprints(["q"])).texts() == b.texts()
    assert fingerprint.compare(spark, none).count() == 0


def test_tokens_round_trip(spark, docs, none, texts):
    from tokenizers import Tokenizer

    import public_tokenizers

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r["doc_id"]: r for r in tokens.output(spark, docs).collect()}
    start = 0
    for i in sorted(texts):
        ids = [*whole.encode(texts[i] or "", add_special_tokens=False).ids, 2]
        want = zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), want)
        start += len(ids)
    assert tokens.output(spark, none).count() == 0


def test_leaks(spark, docs, texts):
    items = spark.createDataFrame([(1, texts[46][:40]), (2, "one"), (3, None), (4, "not in any of them at all")], "item_id long, text string")
    got = {(r["doc_id"], x["item_id"]) for r in with_leaks(spark, docs, items).collect() for x in r["leaks"]}
    assert got == {(46, 1), (43, 2), (44, 2)}


def test_mixing_keeps_the_budget(docs, none):
    rows = mixing.mix(docs, F.lit("d0"), max_epochs=1).collect()
    assert sum(r["n_tokens"] * r["copies"] for r in rows) <= sum(r["n_tokens"] for r in rows) * 0.8 and len(rows) == 47
    assert mixing.mix(none, F.lit("d0")).count() == 0


def test_urls(spark):
    pages = spark.createDataFrame([(1, "http://A.Example.org/es/x?y"), (2, None), (3, "no scheme"), (4, "https://x.com/fr/de/"), (5, "ftp://x.net")], "page_id long, url string")
    marks = spark.createDataFrame([(5, True)], "page_id long, bad boolean")
    got = {r["page_id"]: r for r in urls.judge(spark, pages, marks).collect()}
    assert (got[1]["host"], got[1]["path"], got[1]["rule"], got[1]["verdict"]) == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert (got[2]["host"], got[3]["path"], got[2]["rule"]) == ("", "", None)
    assert (got[4]["rule"], got[4]["verdict"], got[5]["path"]) == ("com/fr/", "allow", "")


def test_tool_calls_are_linked(spark):
    call = '{"tool_calls": [{"id": "a", "name": "f", "arguments": {"x": 1}}, {"id": "b", "name": "f", "arguments": {"y": "s"}, "after": ["a"]}]}'
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", call), (1, 2, "tool", '{"tool_call_id": "a", "content": 3}'), (1, 3, "tool", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    schemas = spark.createDataFrame([("f", "x", "integer", True)], "name string, field string, type string, required boolean")
    shown, calls = chat.link(spark, df, schemas)
    got = {r["call_id"]: r for r in calls.collect()}
    assert (got["a"]["status"], got["a"]["level"], got["a"]["faults"], got["a"]["result_turn"]) == ("linked", 0, [], 2)
    assert (got["b"]["status"], got["b"]["level"], got["b"]["faults"]) == ("no result", 1, ["missing x", "unknown y"])
    assert shown.count() == 4

"""Operators held against brute force where they once did less than the whole job."""

import collections
import json
import random

import pytest
from pyspark.sql import functions as F

from mizan.llm import chat, decontam, mixing, registry
from mizan.llm.common import Scratch

CHAT = "conv_id long, turn long, role string, text string"


def level_of(edges, node, path=()):
    """Longest way up from a call; None on a cycle or behind one."""
    if node in path:
        return None
    above = [level_of(edges, b, (*path, node)) for b in edges[node]]
    return None if None in above else max([x + 1 for x in above], default=0)


def test_levels_of_random_graphs(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for conv in range(12):
        ids = [f"c{i}" for i in range(9)]
        edges = {x: {y for y in ids[: i + (conv % 3 == 0)] if rng.random() < 0.3} for i, x in enumerate(ids)}
        if conv % 4 == 1:
            edges["c2"] = {"c5"}
        for x in ids:
            rows.append((conv, x, [*edges[x], "nowhere"]))
            want[conv, x] = level_of(edges, x)
    calls = spark.createDataFrame(rows, "conv_id long, call_id string, after array<string>")
    got = chat.levels(calls, Scratch(spark, "t")).collect()
    assert len(got) == len({(r["conv_id"], r["call_id"]) for r in got})
    assert {(r["conv_id"], r["call_id"]): r["level"] for r in got} == {k: v for k, v in want.items() if v is not None}
    assert None in want.values() and max(v for v in want.values() if v is not None) > 3


def test_levels_of_a_long_chain(spark):
    calls = spark.range(1500).select(F.lit(1).alias("conv_id"), F.col("id").cast("string").alias("call_id"), F.array((F.col("id") - 1).cast("string")).alias("after"))
    got = chat.levels(calls, Scratch(spark, "t")).collect()
    assert {int(r["call_id"]): r["level"] for r in got} == {i: i for i in range(1500)}


def test_calls_are_linked(spark):
    rng = random.Random(8)
    given = [{"query": "a", "limit": 3}, {"query": 1}, {"limit": "x", "more": True}, {"query": "b"}, [1]]
    rows, calls, results = [], [], []
    for conv in range(15):
        known = []
        for turn in range(0, 12, 2):
            some = []
            for pos in range(rng.randrange(3)):
                i = rng.choice(["a", "b", "c", "d", "e", None])
                call = {"id": i, "name": rng.choice(["search", "search", "other"]), "arguments": rng.choice(given), "after": rng.sample(known, min(len(known), rng.randrange(2)))}
                some.append(call)
                calls.append((conv, turn, pos, call))
            known += [c["id"] for c in some if c["id"]]
            rows.append((conv, turn, "assistant", json.dumps({"tool_calls": some})))
            to = rng.choice(["a", "b", "c", "d", "e"])
            rows.append((conv, turn + 1, "tool", json.dumps({"tool_call_id": to, "content": 1})))
            results.append((conv, turn + 1, to))

    def faults(call):
        if call["name"] != "search":
            return ["unknown tool"]
        a = call["arguments"]
        if not isinstance(a, dict):
            return ["arguments are no object", "missing query"]
        out = [] if "query" in a else ["missing query"]
        types = {"query": str, "limit": int}
        out += [f"unknown {k}" if k not in types else f"{k} is no {'string' if k == 'query' else 'integer'}" for k, v in a.items() if k not in types or not isinstance(v, types[k])]
        return sorted(out)

    want = []
    for conv, turn, pos, c in calls:
        same = [x for v, _, _, x in calls if v == conv and x["id"] == c["id"]]
        edges = {}
        for v, _, _, x in calls:
            if v == conv and x["id"]:
                edges.setdefault(x["id"], set()).update(x["after"])
        first = min((t for v, t, i in results if v == conv and i == c["id"] and t > turn), default=None)
        status = "no id" if c["id"] is None else "repeated id" if len(same) > 1 else "no result" if first is None else "linked"
        level = level_of(edges, c["id"]) if c["id"] else None
        want.append((conv, turn, pos, c["id"], c["name"], json.dumps(c["arguments"], sort_keys=True, separators=(",", ":")), level, first, status, tuple(faults(c))))
    schemas = spark.createDataFrame(chat.SCHEMAS, "name string, field string, type string, required boolean")
    messages = spark.createDataFrame(rows + rows[:9], CHAT)  # some rows twice
    shown, linked = chat.link(spark, messages, schemas)
    got = [tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in linked.collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and {w[8] for w in want} == {"linked", "no result", "repeated id", "no id"}
    shown = {tuple(r) for r in shown.collect()}
    assert sum(r[4] for r in shown) == len(calls) and len(shown) == len(rows)


def test_odd_messages(spark):
    rows = [(None, 1, "assistant", '{"tool_calls": [{"id": "a", "name": "f", "arguments": {}}]}'), (None, 2, "tool", '{"tool_call_id": "a"}'), (1, 1, None, None), (1, 2, "user", '{"a": 1}'), (1, 3, "tool", '\n {"b": 2, "a": 1}'), (1, 4, "assistant", '{"a": 1, "a": 2}')]
    shown, calls = chat.link(spark, spark.createDataFrame(rows, CHAT))
    got = {(r["conv_id"], r["turn"]): r["json"] for r in shown.collect()}
    assert got[1, 1] == "{}" and got[1, 2] == '{"content":"{\\"a\\": 1}","role":"user"}' and got[1, 3] == '{"a":1,"b":2}' and "content" in got[1, 4]
    assert [(r["status"], r["level"]) for r in calls.collect()] == [("no result", None)]
    for x in chat.link(spark, spark.createDataFrame([], CHAT)):
        assert x.count() == 0


def test_the_query_holds_every_case(spark):
    rows = registry.queries()["op5_chat_formatting"](spark, "/root/testdata/sf0.001").filter("kind = 'call'").collect()
    assert {r["status"] for r in rows} == {"linked", "no result", "repeated id", "no id"} and {r["level"] for r in rows} >= {None, 0, 1, 2, 3}
    assert {x for r in rows for x in r["faults"].split("; ")} >= {"", "unknown tool", "missing query", "unknown more", "limit is no integer", "url is no string"}


@pytest.mark.parametrize("small", [0, 200_000])
def test_leaks_of_repeated_and_null_ids(spark, monkeypatch, small):
    monkeypatch.setattr(decontam, "SMALL_BENCHMARK", small)
    w = [f"w{i}" for i in range(40)]
    half, most = " ".join(w[:12]), " ".join(w[:20])
    items = [(1, half + " q r s t u v w x y z a b"), (1, half + " q r s t u v w x y z a b"), (2, most), (2, most), (3, most), (4, " ".join(w[20:32])), (4, " ".join(w[24:36])), (None, most), (None, "only here"), (5, None), (6, ""), (7, "one"), (8, "OTHER  words of ours that stand for nothing")]
    docs = [(1, "x " + half + " y"), (2, " ".join(w[:30])), (2, " ".join(w[:30])), (2, " ".join(w[20:])), (None, "so " + most), (None, "it is only here"), (3, None), (4, ""), (5, "one"), (None, None), (6, " ".join(w[:18]))]

    def runs(x, k):
        x = x.split()
        return {tuple(x[i : i + k]) for i in range(len(x) - k + 1)}

    def leaks(text):
        out = []
        for i, t in items:
            k = min(5, len((t or "").split()))
            s = runs((t or "").lower(), k) if k else set()
            shared = len(s & runs((text or "").lower(), k)) if k else 0
            if s and shared * 100 >= len(s) * 80:
                out.append((i, shared, len(s)))
        return tuple(sorted(out, key=str))

    want = collections.Counter((i, t, leaks(t)) for i, t in docs)
    found = decontam.with_leaks(spark, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert found.columns == ["doc_id", "text", "leaks"]
    assert collections.Counter((r["doc_id"], r["text"], tuple(sorted(map(tuple, r["leaks"]), key=str))) for r in found.collect()) == want
    assert leaks(docs[0][1]) == () and len(leaks(docs[4][1])) == 4


@pytest.mark.parametrize("small", [0, 200_000])
def test_leaks_beside_any_columns(spark, monkeypatch, small):
    monkeypatch.setattr(decontam, "SMALL_BENCHMARK", small)
    names = ["doc_id", "text", "leaks", "items", "probe", "__items", "__text", "c1", "n", "h"]
    docs = spark.createDataFrame([(1, "so one two three four five six", 1, 2, 3, 4, 5, 6, 7, 8), (None, None, 1, 2, 3, 4, 5, 6, 7, 8)], "doc_id long, text string, " + ", ".join(f"`{c}` int" for c in names[2:]))
    items = spark.createDataFrame([(7, "one two three four five six"), (8, "seven")], "item_id long, text string")
    got = decontam.with_leaks(spark, docs, items)
    assert got.columns == ["doc_id", "text", *names[3:], "leaks"]
    assert {r["doc_id"]: [x["item_id"] for x in r["leaks"]] for r in got.collect()} == {1: [7], None: []}
    assert decontam.with_leaks(spark, docs, items.limit(0)).filter("size(leaks) > 0").count() == 0
    assert decontam.with_leaks(spark, docs.limit(0), items).count() == 0


def test_mixing_of_odd_tables(spark):
    """Null names, repeated rows, weights of 0 and clashing columns; a leaf's prefix is the longest its target holds."""
    rng = random.Random(3)
    rows = [(rng.randrange(40), "w " * rng.randrange(9), rng.choice(["en", "fr", None, "xx"]), rng.choice(["s1", "s2", None]), 1, 2, 3) for _ in range(300)]
    df = spark.createDataFrame(rows + rows[:20] + [(None, None, None, None, 1, 2, 3)], "doc_id long, text string, lang string, source string, epoch int, target int, supply int")
    got = mixing.mix(df, F.concat(F.lit("d"), (F.col("doc_id") % 3).cast("string")), domains={"d0": 1, "d1": 0, "d2": 2}, languages={"xx": 0}, max_epochs=1).collect()
    assert len(got) == 321 and {r["epoch"] for r in got} == {1}
    assert all(r["copies"] == 0 for r in got if r["domain"] == "d1" or r["lang"] == "xx")
    leaves = collections.defaultdict(list)
    for r in got:
        leaves[r["domain"], r["lang"] or "", r["source"] or ""].append(r)
    for rs in leaves.values():
        used = sum(r["n_tokens"] * r["copies"] for r in rs)
        left = [r["n_tokens"] for r in rs if not r["copies"]]
        assert sum(r["n_tokens"] for r in rs) == rs[0]["leaf_tokens"] and used <= rs[0]["leaf_target"]
        assert not left or rs[0]["leaf_target"] == 0 or used + max(left) > rs[0]["leaf_target"] or min(left) >= 0
    assert 0 < sum(r["n_tokens"] * r["copies"] for r in got) <= sum(r["n_tokens"] for r in got) * 0.8

"""Phrases in texts against a reading from left to right."""

import random

from mizan.operators import phrases as P

GLOSSARY = [("full option", "trim", "full", None), ("option", "trim", "some", "none"), ("full", "tank", "yes", "no"), ("repainted door", "paint", "spots", "none"), ("door", "parts", "door", None), ("بدون رنگ", "paint", "none", None), ("رنگ", "paint", "spots", "none"), ("...", "x", "y", None), ("Option", "trim", "some", "none"), ("crash repair kit", "parts", "kit", None), ("crash", "accident", "yes", "no")]
SCHEMA = "phrase string, fact string, value string, otherwise string"


def read(text):
    known = {}
    for phrase, fact, value, otherwise in GLOSSARY:
        if phrase != "...":
            known[tuple(phrase.lower().split())] = (fact, value, otherwise)
    w = (text or "").lower().replace(",", " ").split()
    kept, i = [], 0
    while i < len(w):
        n = max((n for n in (1, 2, 3) if tuple(w[i : i + n]) in known and i + n <= len(w)), default=0)
        if n:
            kept.append((i, i + n - 1))
        i += max(n, 1)
    out = []
    for k, (a, b) in enumerate(kept):
        low = max(a - 3, kept[k - 1][1] + 1 if k else 0)
        high = min(b + 3, kept[k + 1][0] - 1 if k + 1 < len(kept) else len(w) - 1)
        negated = any(x in P.NEGATES_NEXT for x in w[low:a]) or any(x in P.NEGATES_LAST for x in w[b + 1 : high + 1])
        fact, value, otherwise = known[tuple(w[a : b + 1])]
        value = otherwise if negated else value
        if value is not None:
            out.append((fact, value, a + 1, b + 1, " ".join(w[a : b + 1]), negated))
    said = {}
    for o in out:
        said.setdefault(o[0], set()).add(o[1])
    return [(*o, len(said[o[0]]) == 1) for o in out]


def test_facts_equal_reading(spark):
    rng = random.Random(9)
    vocabulary = "full option repainted door crash repair kit car no not without sold بدون رنگ نیست ندارد خوب red".split()
    texts = {i: " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(25))) for i in range(60)}
    texts |= {100: None, 101: "", 102: "FULL, option", 103: "no " * 5 + "crash", 104: "full " * 4_000, 105: "crash ندارد"}
    docs = spark.createDataFrame(list(texts.items()), "id long, text string").selectExpr("id", "text", "1 key", "'a' w", "2 first", "3 phrase", "4 value").repartition(3)
    got = P.stated_facts(docs, "id", "text", spark.createDataFrame(GLOSSARY, SCHEMA)).select("key", "fact", "value", "first", "last", "phrase", "negated", "agreed").collect()
    want = [(i, *f) for i, t in texts.items() for f in read(t)]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 4_100 and any(not f[-1] for f in want) and any(f[-2] for f in want)


def test_nothing_to_find(spark):
    docs = spark.createDataFrame([(1, "a b")], "id long, text string")
    for glossary in ([], [("...", "x", "y", None)], [("zzz", "x", "y", None)]):
        assert P.stated_facts(docs, "id", "text", spark.createDataFrame(glossary, SCHEMA)).collect() == []
    assert P.stated_facts(docs.limit(0), "id", "text", spark.createDataFrame(GLOSSARY, SCHEMA)).collect() == []

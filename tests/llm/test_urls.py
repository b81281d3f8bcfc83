"""The template tree, its merging and its verdicts beside a brute-force version, on paths of any depth."""

import math
import random
import re
from collections import Counter, defaultdict

from mizan.llm import urls


def templates_of(rows, many=8, share=0.2):
    """[template] of rows [(host, path)], node by node."""
    parts = [[x for x in p.split("/") if x] for _, p in rows]
    out = [""] * len(rows)
    for level in range(max(map(len, parts), default=0)):
        nodes = defaultdict(Counter)
        for (h, _), s, t in zip(rows, parts, out):
            if len(s) > level:
                nodes[h, t][s[level]] += 1
        nxt = []
        for (h, _), s, t in zip(rows, parts, out):
            if len(s) <= level:
                nxt.append(t)
                continue
            c = nodes[h, t]
            varies = len(c) > many and len(c) >= share * sum(c.values())
            shape = re.sub("[0-9]+", "#", s[level])
            nxt.append(t + "/" + (s[level] if not varies else shape if "#" in shape else "*"))
        out = nxt
    return out


def branches_of(sums, z=1.96):
    """{(host, template): branch} of {(host, template): (labelled, bad)}."""
    out = {k: k[1] for k in sums}
    for level in range(max((t.count("/") for _, t in sums), default=0), 0, -1):
        own = defaultdict(lambda: [0, 0])
        for (h, t), (n, bad) in sums.items():
            own[h, out[h, t]][0] += n
            own[h, out[h, t]][1] += bad
        rest = {}
        for h, b in own:
            s = b.split("/")
            rest[h, b] = "/".join("*" if i == level else x for i, x in enumerate(s))
        pool = defaultdict(lambda: [0, 0, 0])
        for (h, b), (n, bad) in own.items():
            for i, x in enumerate((n, bad, 1)):
                pool[h, rest[h, b]][i] += x
        new = {}
        for (h, b), (n, bad) in own.items():
            pn, pb, kinds = pool[h, rest[h, b]]
            rate = (pb + 1) / (pn + 2)
            alike = n == 0 or abs(bad / n - rate) <= z * math.sqrt(rate * (1 - rate) / n)
            new[h, b] = rest[h, b] if kinds > 1 and alike else b
        out = {(h, t): new[h, b] for (h, t), b in out.items()}
    return out


def pages():
    r = random.Random(3)
    rows = [("a.net", f"/shop/{r.choice('xyz')}/{i}/view") for i in range(60)]
    rows += [("a.net", f"/1/2/3/4/5/6/7/{r.choice(['good', 'bad'])}/{i}") for i in range(40)]
    rows += [("b.net", f"/{r.choice(['u', 'v', 'w'])}/p{r.randrange(40)}.html") for _ in range(80)]
    rows += [("b.net", ""), ("b.net", "/"), ("c.net", "/" + "/".join("abcdefghijkl")), ("c.net", "/" + "/".join("abcdefghijkm"))]
    return rows


def test_templates_branches_and_verdicts(spark):
    rows = pages()
    bad = [int("bad" in p or "/x/" in p or p.startswith("/w/")) if i % 3 else None for i, (_, p) in enumerate(rows)]
    table = spark.createDataFrame([(i, f"http://{h}{p}", "clash") for i, (h, p) in enumerate(rows)], "page_id long, url string, template string")
    marks = spark.createDataFrame([(i, x) for i, x in enumerate(bad)], "page_id long, bad int")
    got = {r["page_id"]: r for r in urls.judge(spark, table, marks).collect()}
    want = templates_of(rows)
    assert [got[i]["template"] for i in range(len(rows))] == want
    sums = defaultdict(lambda: [0, 0])
    for (h, _), t, x in zip(rows, want, bad):
        sums[h, t][0] += x is not None
        sums[h, t][1] += x or 0
    branch = branches_of({k: tuple(v) for k, v in sums.items()})
    assert [got[i]["branch"] for i in range(len(rows))] == [branch[h, t] for (h, _), t in zip(rows, want)]
    total = [sum(v[i] for v in sums.values()) for i in (0, 1)]
    host, own = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for (h, t), v in sums.items():
        for i in (0, 1):
            host[h][i] += v[i]
            own[h, branch[h, t]][i] += v[i]
    for i, ((h, _), t) in enumerate(zip(rows, want)):
        n, k = own[h, branch[h, t]]
        prior = (host[h][1] + 4 * total[1] / total[0]) / (host[h][0] + 4)
        impurity = (k + 4 * prior) / (n + 4)
        assert abs(got[i]["impurity"] - impurity) < 1e-8
        assert got[i]["verdict"] == ("block" if impurity > 0.5 else "allow")
    assert got[60]["template"].count("/") == 9 and {got[i]["verdict"] for i in range(60, 100)} == {"allow", "block"}


def test_empty_tables_null_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    none = spark.createDataFrame([], "page_id long, bad int")
    assert urls.judge(spark, empty, none).collect() == []
    odd = spark.createDataFrame([(None, None), (1, "no scheme"), (1, "no scheme"), (2, "x://Y.Org"), (3, "http://h/" + "a/" * 500)], "page_id long, url string")
    got = urls.judge(spark, odd, none).collect()
    assert sorted((r["page_id"] or 0, r["host"]) for r in got) == [(0, ""), (1, ""), (1, ""), (2, "y.org"), (3, "h")]
    assert all(r["verdict"] == "allow" for r in got)

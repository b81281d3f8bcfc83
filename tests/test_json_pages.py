"""JSON pages: broken parts are kept apart and hide nothing beside them."""

import json

from mizan.sources import json_pages as J

ROW = {"widget_type": "UNEXPANDABLE_ROW", "data": {"title": "a", "value": "b"}}
MODAL = {"widget_type": "SELECTOR_ROW", "data": {"action": {"payload": {"modal_page": {"widget_list": [ROW, {"widget_type": "SELECTOR_ROW", "data": {}}]}}}}}


def frame(spark, bodies):
    return spark.createDataFrame([(i, b if b is None or isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)], "id long, body string").selectExpr("id", "body", "1 key", "2 v", "3 widget", "4 section", "5 pos")


def test_details(spark):
    bodies = [None, "", "{", "[]", {"sections": {}}, {"sections": []}, {"sections": [1, None, {"widgets": 3}, {"widgets": [None, 5, "x", {}, ROW]}]}, {"sections": [{"widgets": [MODAL]}]}, {"sections": [{"widgets": [{"widget_type": "GROUP_INFO_ROW", "data": {"items": [{"title": 1, "value": "t"}, {"title": "t", "value": None}, {"title": "é", "value": "x" * 50_000}]}}]}]}, {"sections": [{"widgets": [{"widget_type": "SCORE_ROW", "data": {"title": "s", "descriptive_score": "good"}}]}]}]
    got = sorted((r.key, r.place, r.kind, r.label, (r.text or "")[:5]) for r in J.detail_rows(frame(spark, bodies), "id", "body").collect())
    want = [(6, [3, 4, -1, -1], "labelled", "a", "b"), (7, [0, 0, 0, -1], "labelled", "a", "b"), (8, [0, 0, -1, 0], "broken", None, "t"), (8, [0, 0, -1, 1], "broken", "t", ""), (8, [0, 0, -1, 2], "labelled", "é", "xxxxx"), (9, [0, 0, -1, -1], "scored", "s", "good")]
    assert got == want
    readable = {r.key: r.readable for r in J.parsed(frame(spark, bodies), "id", "body", "sections").collect()}
    assert [i for i in readable if readable[i]] == [5, 6, 7, 8, 9]


def test_lists_and_records(spark):
    post = lambda t: {"widget_type": "POST_ROW", "data": {"token": t, "title": "x"}}
    bodies = ["nonsense", {"list_widgets": [post("abcd"), post(None), post("a"), {"widget_type": "BANNER"}, post("efgh")]}, {"list_widgets": [post("only")]}, {"list_widgets": [3, post("late")]}]
    got = sorted((r.key, r.pos, r.state) for r in J.list_rows(frame(spark, bodies), "id", "body").collect())
    assert got == [(1, 0, "own"), (1, 1, "broken"), (1, 2, "broken"), (1, 4, "suggested"), (2, 0, "own"), (3, 1, "suggested")]
    rows = J.records(frame(spark, ['[{"a":1,"b":"x"},{"b":"y"},{"a":"no","b":"z"}]', "{}", None, "[]"]), "id", "body", "a int, b string").collect()
    assert sorted(map(tuple, rows), key=str)[:2] == [(0, 1, "x"), (0, None, "y")]

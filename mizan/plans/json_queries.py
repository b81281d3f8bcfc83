"""Registered queries of JSON pages, made of the pages table by an expression that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import functions as F

from mizan.sources import json_pages as J
from mizan.session import table

_URL = """replace(replace(coalesce(url, ''), '"', ''), '\\\\', '')"""
DETAIL = f"""CASE page_id % 13 WHEN 0 THEN '{{"sections":' WHEN 1 THEN '{{"sections":{{}}}}' ELSE '{{"sections":[{{"name":"a","widgets":[{{"widget_type":"GROUP_INFO_ROW","data":{{"items":[{{"title":"url","value":"' || {_URL} || '"}},{{"title":"size","value":' || CAST(length(html) AS VARCHAR(12)) || '}},{{"value":"x"}}]}}}},{{"widget_type":"OTHER"}},'
 || CASE page_id % 3 WHEN 0 THEN '{{"widget_type":"SELECTOR_ROW","data":{{"action":{{"payload":{{"modal_page":{{"widget_list":[{{"widget_type":"UNEXPANDABLE_ROW","data":{{"title":"page","value":"' || CAST(page_id AS VARCHAR(12)) || '"}}}},{{"widget_type":"GROUP_INFO_ROW","data":{{"items":[{{"title":"deep","value":"yes"}}]}}}}]}}}}}}}}}}' WHEN 1 THEN '{{"widget_type":"UNEXPANDABLE_ROW","data":{{"title":"fuel"}}}}' ELSE '7' END
 || ']}},{{"widgets":[{{"widget_type":"SCORE_ROW","data":{{"title":"body","descriptive_score":"s' || CAST(page_id % 7 AS VARCHAR(3)) || '"}}}}]}},{{"widgets":null}}]}}' END"""
LIST = f"""'{{"list_widgets":[{{"widget_type":"POST_ROW","data":{{"token":"tok' || CAST(page_id AS VARCHAR(12)) || '","title":"' || {_URL} || '"}}}},{{"widget_type":"POST_ROW","data":{{"token":"' || CASE WHEN page_id % 4 = 0 THEN '?' ELSE 'abcd' END || '"}}}}' || CASE page_id % 3 WHEN 0 THEN ',{{"widget_type":"BANNER"}}' WHEN 1 THEN ',{{}}' ELSE '' END || ',{{"widget_type":"POST_ROW","data":{{"token":"last-1"}}}}]}}'"""
RECORDS = """'[{"id":' || CAST(page_id AS VARCHAR(12)) || ',"name":"n' || CAST(page_id % 5 AS VARCHAR(3)) || '"},{"id":null,"name":"x","more":1}' || CASE WHEN page_id % 2 = 0 THEN ',{"name":"z","id":3}' ELSE '' END || ']'"""


def made(s, d, body):
    return table(s, d, "pages").select("page_id", F.expr(body).alias("body"))


_S = lambda v, path: f"CASE WHEN json_type({v}, '{path}') = 'VARCHAR' THEN json_extract_string({v}, '{path}') END"
_EACH = lambda frm, keep, v, path, out: f"SELECT {keep}, CAST(i - 1 AS INT) AS {out}_pos, json_extract(arr, '$[' || (i - 1) || ']') AS {out} FROM (SELECT {keep}, json_extract({v}, '{path}') AS arr, unnest(range(1, CAST(json_array_length({v}, '{path}') + 1 AS BIGINT))) AS i FROM {frm} WHERE json_type({v}, '{path}') = 'ARRAY')"
DETAIL_SQL = f"""WITH p AS (SELECT page_id AS key, {DETAIL} AS body FROM pages), j AS (SELECT key, CASE WHEN json_valid(body) THEN CAST(body AS JSON) END AS v FROM p),
s AS ({_EACH('j', 'key', 'v', '$.sections', 'section')}), w AS ({_EACH('s', 'key, section_pos', 'section', '$.widgets', 'widget')}),
m AS ({_EACH(f"(SELECT * FROM w WHERE {_S('widget', '$.widget_type')} = 'SELECTOR_ROW')", 'key, section_pos, widget_pos', 'widget', J.MODAL, 'modal')}),
b AS (SELECT key, section_pos, widget_pos, -1 AS modal_pos, widget, {_S('widget', '$.widget_type')} AS type FROM w UNION ALL SELECT key, section_pos, widget_pos, modal_pos, modal, {_S('modal', '$.widget_type')} FROM m),
g AS ({_EACH("(SELECT * FROM b WHERE type = 'GROUP_INFO_ROW')", 'key, section_pos, widget_pos, modal_pos', 'widget', '$.data.items', 'item')}),
r AS (SELECT key, [section_pos, widget_pos, modal_pos, item_pos] AS place, 'labelled' AS kind, {_S('item', '$.title')} AS label, {_S('item', '$.value')} AS text FROM g
 UNION ALL SELECT key, [section_pos, widget_pos, modal_pos, -1], CASE type WHEN 'SCORE_ROW' THEN 'scored' ELSE 'labelled' END, {_S('widget', '$.data.title')}, CASE type WHEN 'SCORE_ROW' THEN {_S('widget', '$.data.descriptive_score')} ELSE {_S('widget', '$.data.value')} END FROM b WHERE type IN ('UNEXPANDABLE_ROW', 'SCORE_ROW'))
SELECT key, place, CASE WHEN label IS NULL OR text IS NULL THEN 'broken' ELSE kind END AS kind, label, text FROM r"""
LIST_SQL = f"""WITH j AS (SELECT page_id AS key, CAST({LIST} AS JSON) AS v FROM pages), w AS ({_EACH('j', 'key', 'v', '$.list_widgets', 'widget')}),
t AS (SELECT key, widget_pos AS pos, coalesce({_S('widget', '$.widget_type')}, '') = 'POST_ROW' AS post, {_S('widget', '$.data.token')} AS token, {_S('widget', '$.data.title')} AS title FROM w),
e AS (SELECT *, min(pos) FILTER (WHERE NOT post) OVER (PARTITION BY key) AS ends FROM t)
SELECT key, pos, token, title, CASE WHEN pos > ends THEN 'suggested' WHEN coalesce(regexp_full_match(token, '[A-Za-z0-9_-]{{4,}}'), false) THEN 'own' ELSE 'broken' END AS state FROM e WHERE post"""

QUERIES = {
    "src03_detail_rows": (lambda s, d: J.detail_rows(made(s, d, DETAIL), "page_id", "body"), DETAIL_SQL),
    "src04_list_rows": (lambda s, d: J.list_rows(made(s, d, LIST), "page_id", "body"), LIST_SQL),
    "src05_found_values": (
        lambda s, d: J.found_values(made(s, d, DETAIL), "page_id", "body", "sections", "widgets", "widget_type").groupBy("value").agg(F.count("*").alias("n")),
        f"WITH p AS (SELECT page_id AS key, {DETAIL} AS body FROM pages), j AS (SELECT key, CASE WHEN json_valid(body) THEN CAST(body AS JSON) END AS v FROM p), s AS ({_EACH('j', 'key', 'v', '$.sections', 'a')}), w AS ({_EACH('s', 'key', 'a', '$.widgets', 'b')}) SELECT {_S('b', '$.widget_type')} AS value, count(*) AS n FROM w WHERE {_S('b', '$.widget_type')} IS NOT NULL GROUP BY 1",
    ),
    "src07_records": (
        lambda s, d: J.records(made(s, d, RECORDS), "page_id", "body", "id bigint, name string"),
        f"WITH j AS (SELECT page_id AS key, CAST({RECORDS} AS JSON) AS v FROM pages), e AS ({_EACH('j', 'key', 'v', '$', 'r')}) SELECT key, CAST(json_extract(r, '$.id') AS BIGINT) AS id, json_extract_string(r, '$.name') AS name FROM e",
    ),
}

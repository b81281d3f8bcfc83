"""Registered queries of change capture, freshness, alerts, budgets and text."""

from __future__ import annotations

from pyspark.sql import functions as F

from mizan.functions import text as T
from mizan.operators import events as E
from mizan.operators import predicates as P
from mizan.plans.listing import NOW, RATED_SQL, YEAR_NOW, listings, rated
from mizan.session import table

END = "2024-01-30 00:00:00"


def at(x):
    return F.lit(x).cast("timestamp_ntz")


def observed(s, d):
    """Events as price observations: errors are negotiable prices; prices are whole and coarse, so some repeat."""
    e = table(s, d, "events")
    kind = F.when(F.col("event_type") == "error", "negotiable").otherwise("asking")
    return e.select(F.col("user_id").alias("listing_id"), F.col("ts").alias("observed_at"), kind.alias("price_type"), F.when(kind == "asking", (F.floor(F.col("value") / 100) * 100).cast("long")).alias("asking_price"))


CHANGES_SQL = """WITH o AS (SELECT user_id AS listing_id, ts AS observed_at, CASE WHEN event_type = 'error' THEN 'negotiable' ELSE 'asking' END AS price_type,
 CASE WHEN event_type <> 'error' THEN CAST(floor(value / 100) * 100 AS BIGINT) END AS asking_price FROM events),
l AS (SELECT *, lag(price_type) OVER w AS previous_type, lag(asking_price) OVER w AS previous_price,
 last_value(asking_price IGNORE NULLS) OVER (PARTITION BY listing_id ORDER BY observed_at, price_type, asking_price ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_asking_price
 FROM o WINDOW w AS (PARTITION BY listing_id ORDER BY observed_at, price_type, asking_price)),
c AS (SELECT * FROM l WHERE price_type IS DISTINCT FROM previous_type OR asking_price IS DISTINCT FROM previous_price)
"""


def halves(s, d):
    """Customers as they are stored, and as they are read anew: some gone, some new, some changed."""
    rows = table(s, d, "customer").select(F.col("c_custkey").alias("key"), "c_name", "c_nationkey")
    stored = rows.filter("key % 10 <> 0")
    fresh = rows.filter("key % 7 <> 0").withColumn("c_nationkey", F.when(F.col("key") % 13 == 0, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey")))
    return stored, fresh


HALVES_SQL = """WITH stored AS (SELECT c_custkey AS key, c_name, c_nationkey FROM customer WHERE c_custkey % 10 <> 0),
fresh AS (SELECT c_custkey AS key, c_name, CASE WHEN c_custkey % 13 = 0 THEN c_nationkey + 1 ELSE c_nationkey END AS c_nationkey FROM customer WHERE c_custkey % 7 <> 0)
"""
DAY_SQL = "CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Tehran' AS DATE)"
FILES = {"cheap": P.Search({"price": {"max": 20_000}}), "good": P.Search({"deal": "good"}), "clean": P.Search({"no_accident": True, "gearbox": ["F"]})}
FILES_SQL = {"cheap": "asking_price <= 20000", "good": "rating IN ('great', 'good')", "clean": "accident IS DISTINCT FROM 'had_accident' AND gearbox = 'F'"}


def alerts(s, d):
    clock = P.Clock(NOW, YEAR_NOW)
    files = [(k, P.searchable(v, clock)) for k, v in FILES.items()]
    return E.matched(files, rated(s, d), at("2001-01-01 00:00:00"), at("2001-06-30 23:59:00"), "listed_at")


def numbers(s, d):
    """Numbers as written: grouped, in other digits, with a unit, or broken."""
    k = table(s, d, "orders").select("o_orderkey", F.round("o_totalprice").cast("long").alias("n"))
    shown = F.when(F.col("o_orderkey") % 4 == 0, F.format_number("n", 0)).when(F.col("o_orderkey") % 4 == 1, T.to_persian_digits(F.col("n").cast("string"))).when(F.col("o_orderkey") % 4 == 2, F.concat(F.col("n").cast("string"), F.lit(",1"))).otherwise(F.col("n").cast("string"))
    return k.select("o_orderkey", T.whole_number(shown).alias("n"))


WORDS_SQL = r"""WITH w AS (SELECT DISTINCT doc_id, unnest(string_split(trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '([\p{L}])([\p{N}])', '\1 \2', 'g'), '([\p{N}])([\p{L}])', '\1 \2', 'g'), '[^\p{L}\p{N}\p{M}]+', ' ', 'g')), ' ')) AS word FROM documents WHERE text IS NOT NULL)
SELECT word, count(*) AS df FROM w WHERE word <> '' GROUP BY word"""

QUERIES = {
    "stm01_price_changes": (lambda s, d: E.price_changes(observed(s, d)), CHANGES_SQL + "SELECT * FROM c"),
    "stm02_price_drops": (lambda s, d: E.price_drops(E.price_changes(observed(s, d))), CHANGES_SQL + "SELECT * FROM c WHERE price_type = 'asking' AND asking_price < last_asking_price"),
    "qry23_price_history": (
        lambda s, d: E.price_history(E.price_changes(observed(s, d)).filter("asking_price > 0")),
        CHANGES_SQL + "SELECT listing_id, count(*) AS changes, arg_min(asking_price, observed_at) AS first_price, arg_max(asking_price, observed_at) AS last_price, CAST(max(observed_at) AS DATE) - CAST(min(observed_at) AS DATE) AS days, round((arg_max(asking_price, observed_at) - arg_min(asking_price, observed_at)) * 100 / arg_min(asking_price, observed_at), 4) AS total_change FROM c WHERE asking_price > 0 GROUP BY 1",
    ),
    "stm03_sightings": (lambda s, d: E.sightings(table(s, d, "events"), "user_id", "ts"), "SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n FROM events GROUP BY 1"),
    "snk01_difference": (lambda s, d: E.difference(*halves(s, d), "key"), HALVES_SQL + "SELECT coalesce(s.key, f.key) AS key, CASE WHEN s.key IS NULL THEN 'insert' WHEN f.key IS NULL THEN 'delete' ELSE 'update' END AS action FROM stored s FULL JOIN fresh f ON s.key = f.key WHERE s.key IS NULL OR f.key IS NULL OR s.c_name IS DISTINCT FROM f.c_name OR s.c_nationkey IS DISTINCT FROM f.c_nationkey"),
    "snk02_removed": (lambda s, d: (lambda h: h[0].join(h[1], "key", "left_anti"))(halves(s, d)), HALVES_SQL + "SELECT * FROM stored WHERE NOT EXISTS (SELECT 1 FROM fresh WHERE fresh.key = stored.key)"),
    "snk03_insert_if_absent": (lambda s, d: E.inserted_if_absent(*halves(s, d), ["key"]), HALVES_SQL + "SELECT * FROM fresh WHERE key NOT IN (SELECT key FROM stored)"),
    "snk04_bounded_counts": (lambda s, d: E.bounded_counts(table(s, d, "events").groupBy("user_id").agg(F.count("*").alias("n")), table(s, d, "events").filter("event_type = 'view'"), ["user_id"], 80), "SELECT user_id, CAST(least(count(*) + count(*) FILTER (WHERE event_type = 'view'), 80) AS BIGINT) AS n FROM events GROUP BY 1"),
    "stm13_freshness": (
        lambda s, d: E.freshness(table(s, d, "events"), "ts", "value", at("2024-01-10 00:00:00"), at("2024-01-11 00:00:00")),
        "SELECT count(*) AS n, CAST(round_even(quantile_cont(greatest(value, 0), 0.5), 0) AS BIGINT) AS p50, CAST(round_even(quantile_cont(greatest(value, 0), 0.9), 0) AS BIGINT) AS p90 FROM events WHERE ts > TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-11'",
    ),
    "stm13_sliding": (
        lambda s, d: E.sliding(table(s, d, "events"), "ts", "value"),
        "WITH g AS (SELECT unnest(generate_series(TIMESTAMP '2023-12-31', TIMESTAMP '2024-02-03', INTERVAL 6 HOUR)) AS ends) SELECT ends, count(*) AS n, round(quantile_cont(value, 0.5), 4) AS p50 FROM g JOIN events ON ts > ends - INTERVAL 24 HOUR AND ts <= ends GROUP BY ends",
    ),
    "stm16_sessions": (
        lambda s, d: E.sessions(table(s, d, "events"), "user_id", "ts"),
        "WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM m) SELECT user_id, min(ts) AS starts, count(*) AS n FROM g GROUP BY user_id, s",
    ),
    "stm14_flows": (
        lambda s, d: E.flows(table(s, d, "events"), "ts", at(END), "event_type"),
        "SELECT event_type AS kind, " + ", ".join(f"count(*) FILTER (WHERE ts > TIMESTAMP '{END}' - INTERVAL {i} AND ts <= TIMESTAMP '{END}') AS {n}" for n, i in (("hour", "1 HOUR"), ("day", "1 DAY"), ("week", "7 DAY"))) + " FROM events GROUP BY 1",
    ),
    "stm16_heartbeats": (lambda s, d: E.silent(table(s, d, "events"), "user_id", "ts", at(END), 86_400), f"SELECT user_id, max(ts) AS last, max(ts) >= TIMESTAMP '{END}' - INTERVAL 1 DAY AS alive FROM events GROUP BY 1"),
    "agg21_daily_spend": (lambda s, d: E.daily_spend(table(s, d, "events"), "ts", ["event_type"], "value"), f"SELECT event_type, {DAY_SQL} AS day, count(*) AS n, round(sum(value), 4) AS spent FROM events GROUP BY 1, 2"),
    "stm17_budget": (
        lambda s, d: E.within_budget(table(s, d, "events").select("ts", "event_type", E.tehran_day(F.col("ts")).alias("day")), "day", "ts", 200, {"view": 0.25, "click": 0.5}, "event_type").groupBy("day", "event_type").agg(F.count_if("allowed").alias("allowed"), F.count("*").alias("n")),
        f"""WITH p AS (SELECT {DAY_SQL} AS day, event_type, CASE event_type WHEN 'click' THEN 100 WHEN 'view' THEN 150 ELSE 200 END AS most, row_number() OVER (PARTITION BY {DAY_SQL} ORDER BY ts) AS place FROM events),
 a AS (SELECT day, place, row_number() OVER (PARTITION BY day ORDER BY place) AS k FROM p WHERE place > 100 AND most >= 150), ea AS (SELECT day, max(place) FILTER (WHERE k = 50) AS e FROM a GROUP BY 1),
 b AS (SELECT p.day, place, row_number() OVER (PARTITION BY p.day ORDER BY place) AS k FROM p JOIN ea ON ea.day = p.day AND place > e WHERE most >= 200), eb AS (SELECT day, max(place) FILTER (WHERE k = 50) AS e FROM b GROUP BY 1)
 SELECT p.day, event_type, count(*) FILTER (WHERE place <= CASE most WHEN 100 THEN 100 WHEN 150 THEN coalesce(ea.e, place) ELSE coalesce(eb.e, place) END) AS allowed, count(*) AS n FROM p LEFT JOIN ea ON ea.day = p.day LEFT JOIN eb ON eb.day = p.day GROUP BY 1, 2""",
    ),
    "stm10_throttled": (
        lambda s, d: E.throttled(table(s, d, "events").select("user_id", "ts"), "user_id", "ts"),
        f"""WITH RECURSIVE e AS (SELECT user_id, ts, {DAY_SQL} AS day FROM events),
 sent AS (SELECT user_id, min(ts) AS ts, arg_min(day, ts) AS day, 1 AS place FROM e GROUP BY 1
 UNION ALL SELECT s.user_id, min(e.ts), arg_min(e.day, e.ts), CASE WHEN arg_min(e.day, e.ts) = any_value(s.day) THEN any_value(s.place) + 1 ELSE 1 END FROM sent s JOIN e ON e.user_id = s.user_id AND e.ts >= s.ts + INTERVAL 120 MINUTE AND NOT (e.day = s.day AND s.place >= 8) GROUP BY s.user_id)
 SELECT user_id, ts, day, CAST(place AS INT) AS place FROM sent""",
    ),
    "stm11_once": (lambda s, d: E.once(table(s, d, "events").select(F.col("user_id").alias("account"), F.col("event_type").alias("event_key"), F.col("ts").alias("at"))), "SELECT user_id AS account, event_type AS event_key, min(ts) AS at FROM events GROUP BY 1, 2"),
    "stm09_alerts": (
        alerts,
        RATED_SQL + " UNION ALL ".join(f"SELECT '{k}' AS file, count(*) AS n, count(*) FILTER (WHERE rating IN ('great', 'good')) AS good, max(listed_at) AS newest FROM rated WHERE listed_at > TIMESTAMP '2001-01-01' AND listed_at <= TIMESTAMP '2001-06-30 23:59:00' AND {v} HAVING count(*) > 0" for k, v in FILES_SQL.items()),
    ),
    "str02_whole_number": (numbers, "SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 2 THEN CAST(round(o_totalprice) AS BIGINT) END AS n FROM orders"),
    "agg17_vocabulary": (lambda s, d: T.vocabulary(table(s, d, "documents"), "text"), WORDS_SQL),
    "txt04_text_match": (
        lambda s, d: table(s, d, "part").filter(T.matches(T.lexemes(F.col("p_type")), [("pro", False)]) | T.matches(T.lexemes(F.col("p_type")), [("standard", True)])).groupBy("p_type").agg(F.count("*").alias("n")),
        "SELECT p_type, count(*) AS n FROM part WHERE starts_with(lower(p_type), 'pro') OR lower(p_type) = 'standard' GROUP BY 1",
    ),
}

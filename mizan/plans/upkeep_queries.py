"""Registered queries of upkeep: what is evicted and kept, cleared tests, inboxes, flags, states and times."""

from __future__ import annotations

from pyspark.sql import functions as F

from mizan.functions import calendar as C
from mizan.functions import extraction as X
from mizan.operators import document as D
from mizan.operators import events as E
from mizan.operators import valuation as V
from mizan.plans.event_queries import END, at
from mizan.plans.listing import LISTINGS_SQL, listings
from mizan.session import table

MOST, KEEP, DAYS = 60, 50, 10
OWNER = 7
#: What a text may say, in turn by order key: fixed values of both forms.
PAIRS = [("price_meaning", "down_payment"), ("price_meaning", "starting_from"), ("installment", "yes"), ("paint", D.PAINTED_TEXT[0]), ("chassis", "damaged"), ("accident", "had_accident"), ("plate", "free_zone"), ("ride_hailing", "used"), ("other", "x")]


def asked(s, d):
    """Questions: an event's user and type on a day, how often and when last."""
    e = table(s, d, "events").withColumn("key", F.concat_ws("-", "user_id", "event_type", F.date_format("ts", "yyyy-MM-dd")))
    return e.groupBy("key").agg(F.max("ts").alias("at"), F.count("*").alias("n"))


ASKED_SQL = "r AS (SELECT concat_ws('-', user_id, event_type, strftime(ts, '%Y-%m-%d')) AS key, max(ts) AS at_, count(*) AS n FROM events GROUP BY 1)"


def inbox(s, d):
    notices = table(s, d, "events").select(F.col("user_id").alias("account_id"), F.col("event_id").alias("id"), F.col("ts").alias("created_at"))
    last = notices.filter(F.col("account_id") == OWNER).agg(F.max("id")).first()[0]
    return D.after_in_inbox(notices, OWNER, last)


def drops(s, d):
    e = table(s, d, "events")
    changes = e.select(F.col("user_id").alias("listing_id"), F.col("event_id").alias("id"), F.when(F.col("event_type") == "error", "negotiable").otherwise("asking").alias("price_type"), F.floor("value").cast("long").alias("asking_price"), (F.col("event_id") * 7 % 300).cast("long").alias("last_asking_price"))
    marks = table(s, d, "customer").select((F.col("c_custkey") % 40).alias("account_id"), F.col("c_custkey").alias("listing_id"), (F.col("c_custkey") * 13 % 900).alias("seen_id"))
    return D.drop_notices(marks, changes)


def flags(s, d):
    k = F.col("o_orderkey")
    turn = lambda n, *v: F.get(F.array(*map(F.lit, v)), (F.floor(k / n) % len(v)).cast("int"))
    said = F.get(F.array(*[F.struct(F.lit(a).alias("field"), F.lit(b).alias("value")) for a, b in PAIRS]), (k % len(PAIRS)).cast("int"))
    o = table(s, d, "orders").select("o_orderkey", turn(3, "asking", "installment", None).alias("price_type"), turn(5, True, False, None).alias("takes"), F.when(k % 11 > 0, 5).alias("km"), turn(7, "intact", "salvage", None).alias("body"), turn(2, "intact", "damaged", None).alias("front"), turn(13, None, "intact").alias("rear"), turn(4, "installment_price", "price_outlier", None).alias("why"), F.array(said).alias("facts"))
    return o.select("o_orderkey", D.risk_flags("price_type", "takes", "km", "body", "front", "rear", "why", "facts").alias("flags"))


_TURN = lambda n, *v: "[" + ", ".join("NULL" if x is None else str(x).lower() if isinstance(x, bool) else f"'{x}'" for x in v) + f"][CAST(o_orderkey // {n} % {len(v)} AS INT) + 1]"
FLAGS_SQL = f"""WITH o AS (SELECT o_orderkey, {_TURN(3, 'asking', 'installment', None)} AS price_type, coalesce({_TURN(5, True, False, None)}, false) AS takes, o_orderkey % 11 > 0 AS km, {_TURN(7, 'intact', 'salvage', None)} AS body, {_TURN(2, 'intact', 'damaged', None)} AS front, {_TURN(13, None, 'intact')} AS rear, {_TURN(4, 'installment_price', 'price_outlier', None)} AS why,
 {_TURN(1, *[a for a, _ in PAIRS])} AS f, {_TURN(1, *[b for _, b in PAIRS])} AS v FROM orders)
SELECT o_orderkey, list_filter([CASE WHEN price_type = 'installment' OR v = 'down_payment' THEN 'down_payment' WHEN v = 'starting_from' THEN 'starting_from' WHEN takes OR f = 'installment' THEN 'installments' END,
 CASE WHEN why = 'installment_price' AND coalesce(price_type, '') <> 'installment' AND takes THEN 'installment_guard' END, CASE WHEN NOT km THEN 'mileage_unread' END,
 CASE WHEN body = 'intact' AND f = 'paint' THEN 'paint_conflict' END, CASE WHEN (front = 'intact' OR rear = 'intact') AND f = 'chassis' THEN 'chassis_conflict' END, CASE WHEN body = 'intact' AND f = 'accident' THEN 'accident_conflict' END,
 CASE WHEN f = 'plate' THEN 'free_zone' END, CASE WHEN f = 'ride_hailing' THEN 'ride_hailing' END, CASE WHEN why = 'price_outlier' THEN 'price_outlier' END], lambda x: x IS NOT NULL) AS flags FROM o"""

_MEANINGS = "CASE o_orderkey % 4 WHEN 0 THEN {a}('down_payment'{z} WHEN 1 THEN {a}('starting_from', 'down_payment'{z} WHEN 2 THEN {a}('other'{z} END"
QUERIES = {
    "snk05_evicted": (
        lambda s, d: E.evicted(asked(s, d), "at", MOST, KEEP).select("key", "n"),
        f"WITH {ASKED_SQL}, c AS (SELECT count(*) AS m FROM r), o AS (SELECT key, row_number() OVER (ORDER BY at_, key) AS p FROM r WHERE n = 1) SELECT key, n FROM r WHERE key NOT IN (SELECT o.key FROM o, c WHERE m >= {MOST} AND p <= m - {KEEP})",
    ),
    "snk06_retained": (
        lambda s, d: E.retained(table(s, d, "events").select(F.col("event_id").alias("run_id"), F.to_date("ts").alias("as_of_date"), F.col("event_type").alias("method")), F.lit("2024-01-25").cast("date"), DAYS),
        f"SELECT event_id AS run_id, CAST(ts AS DATE) AS as_of_date, event_type AS method FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-25' - {DAYS} QUALIFY row_number() OVER (PARTITION BY CAST(ts AS DATE), event_type ORDER BY event_id DESC) = 1",
    ),
    "val11_untested": (
        lambda s, d: V.untested(listings(s, d).select("listing_id", F.when(F.col("photo_count") % 3 > 0, F.col("photo_count")).alias("price_ratio")), listings(s, d).filter("mileage_km < 100000")),
        LISTINGS_SQL + "SELECT listing_id, photo_count AS price_ratio FROM listings WHERE photo_count % 3 > 0 AND coalesce(mileage_km >= 100000, true)",
    ),
    "ext13_text_price": (
        lambda s, d: table(s, d, "orders").select("o_orderkey", X.with_text_price(F.when(F.col("o_orderkey") % 3 == 0, "asking").when(F.col("o_orderkey") % 3 == 1, "negotiable"), F.round("o_totalprice").cast("long"), F.expr(_MEANINGS.format(a="array", z=")"))).alias("p")).select("o_orderkey", "p.*"),
        f"WITH o AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'asking' WHEN 1 THEN 'negotiable' END AS k, CAST(round(o_totalprice) AS BIGINT) AS n, {_MEANINGS.format(a='list_value', z=')')} AS m FROM orders), x AS (SELECT *, coalesce(k = 'asking' AND list_contains(m, 'down_payment'), false) AS down FROM o) SELECT o_orderkey, CASE WHEN down THEN 'installment' ELSE k END AS price_type, CASE WHEN NOT down THEN n END AS asking_price, CASE WHEN down THEN n END AS down_payment FROM x",
    ),
    "stm12_drop_notices": (
        drops,
        """WITH c AS (SELECT user_id AS listing_id, event_id AS id, event_type <> 'error' AS asking, CAST(floor(value) AS BIGINT) AS asking_price, CAST(event_id * 7 % 300 AS BIGINT) AS last_asking_price FROM events),
m AS (SELECT c_custkey % 40 AS account_id, c_custkey AS listing_id, c_custkey * 13 % 900 AS seen_id FROM customer), n AS (SELECT account_id, listing_id, id, asking, last_asking_price, asking_price, max(id) OVER (PARTITION BY account_id, listing_id) AS seen_through FROM m JOIN c USING (listing_id) WHERE id > seen_id)
SELECT account_id, listing_id, id, last_asking_price, asking_price, seen_through FROM n WHERE asking AND asking_price < last_asking_price""",
    ),
    "srt06_inbox": (inbox, f"WITH e AS (SELECT user_id AS account_id, event_id AS id, ts AS created_at FROM events WHERE user_id = {OWNER}), l AS (SELECT arg_max(created_at, id) AS c, max(id) AS i FROM e) SELECT account_id, id, created_at FROM e, l WHERE (created_at, id) < (c, i)"),
    "qry24_risk_flags": (flags, FLAGS_SQL),
    "stm19_states": (
        lambda s, d: table(s, d, "events").groupBy(D.source_state(F.when(F.col("event_type") != "error", "enabled"), F.col("ts"), at(END), 60 * 24).alias("state"), D.target_status(F.when(F.col("event_id") % 5 > 0, F.col("value")), 100).alias("target")).agg(F.count("*").alias("n")),
        f"SELECT CASE WHEN event_type = 'error' THEN 'not_updating' WHEN TIMESTAMP '{END}' - ts > INTERVAL 1 DAY THEN 'delayed' ELSE 'live' END AS state, CASE WHEN event_id % 5 = 0 THEN 'unmeasured' WHEN value <= 100 THEN 'met' ELSE 'missed' END AS target, count(*) AS n FROM events GROUP BY 1, 2",
    ),
    "dat02_ago": (
        lambda s, d: table(s, d, "events").select(C.ago(F.col("ts"), at(END)).alias("a")).groupBy("a.unit", "a.n").agg(F.count("*").alias("rows")),
        f"WITH e AS (SELECT CAST(greatest(floor(epoch(TIMESTAMP '{END}')) - floor(epoch(ts)), 0) AS BIGINT) AS s FROM events) SELECT CASE WHEN s >= 86400 THEN 'day' WHEN s >= 3600 THEN 'hour' WHEN s >= 60 THEN 'minute' ELSE 'now' END AS unit, CASE WHEN s >= 86400 THEN s // 86400 WHEN s >= 3600 THEN s // 3600 WHEN s >= 60 THEN s // 60 ELSE 0 END AS n, count(*) AS rows FROM e GROUP BY 1, 2",
    ),
    "prj15_baseline": (
        lambda s, d: table(s, d, "events").select("event_id", D.seen_baseline(F.col("ts"), F.col("ts") - F.expr("INTERVAL 1 DAY"), F.col("ts") + F.make_dt_interval(mins=(F.col("event_id") % 10).cast("int"))).alias("since")),
        "SELECT event_id, CASE WHEN event_id % 10 < 5 THEN ts - INTERVAL 1 DAY ELSE ts END AS since FROM events",
    ),
}

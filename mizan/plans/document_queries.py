"""Registered queries of the search document, the calendar, notices and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from mizan.functions import calendar as C
from mizan.functions import extraction as X
from mizan.operators import document as D
from mizan.operators import predicates as P
from mizan.operators.events import tehran_day
from mizan.plans.event_queries import DAY_SQL
from mizan.plans.listing import LISTINGS_SQL, NOW, RATED_SQL, YEAR_NOW, listings, now, rated
from mizan.session import table

#: What sources write, and what it means, in turn by order key: fixed values of both forms.
WRITTEN = {
    "km": (["۹۱۰۰۰", "۱۲۰,۰۰۰ کیلومتر", "1000000", "نامعلوم"], ["91000", "120000", None, None]),
    "gearbox": (["دنده‌ای", "اتوماتیک", "دستی"], ["manual", "automatic", None]),
    "fuel": (["بنزین", "برقی", "برق", "گازوئیل", "آب"], ["petrol", "electric", "electric", "diesel", None]),
    "body": (["سالم و بی‌خط و خش", "رنگ‌شدگی، در ۳ ناحیه", "اوراقی", "خوب"], ["intact", "partly_repainted", "salvage", None]),
    "months": (["۶ ماه", "۱۲ ماه", "۱۳ ماه"], ["6", "12", None]),
    "part": (["سالم و پلمپ", "تعیین‌نشده", "تعمیر شده"], ["sound", None, "repaired"]),
}
READS = {"km": X.mileage, "gearbox": X.gearbox, "fuel": X.fuel, "body": X.body, "months": X.insurance_months, "part": X.part}


def turn(values: list[str]):
    return F.get(F.array(*map(F.lit, values)), (F.col("o_orderkey") % len(values)).cast("int"))


def attributes(s, d):
    return table(s, d, "orders").select("o_orderkey", *[READS[k](turn(w))["value"].cast("string").alias(k) for k, (w, _) in WRITTEN.items()])


def sql_list(values):
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


def field_tallies(s, d):
    rows = table(s, d, "orders").select(F.lit("gearbox").alias("field"), F.when(F.col("o_orderkey") % 5 > 0, turn(WRITTEN["gearbox"][0])).alias("text"))
    return X.tallies(rows.withColumn("r", X.gearbox(F.col("text"))), "field", "r", "text")


FACTS = {"front": ["intact", "damaged", "repainted", None, "intact"], "rear": ["intact", None, "intact", None, "repainted", "intact", None], "chassis": ["damaged", "intact", None], "paint": ["none", "spots", None], "body": ["intact", "salvage", "fully_repainted", "minor_scratches", None], "crash": ["had_accident", "none", None, None], "swap": ["yes", "no", None], "accepts": ["true", "false", None, None]}


def facts(s, d):
    """Orders as listings with structured fields and text facts, in turn by key."""
    pick = lambda v: F.get(F.array(*map(F.lit, v)), (F.floor(F.col("o_orderkey") / 3) % len(v)).cast("int"))
    return table(s, d, "orders").select("o_orderkey", *[pick(v).alias(k) for k, v in FACTS.items()]).withColumn("accepts", F.col("accepts").cast("boolean"))


FACTS_SQL = "WITH f AS (SELECT o_orderkey, " + ", ".join(f"CAST({sql_list(v)}[CAST(o_orderkey // 3 % {len(v)} AS INT) + 1] AS {'BOOLEAN' if k == 'accepts' else 'VARCHAR'}) AS {k}" for k, v in FACTS.items()) + " FROM orders)\n"
PAINTED = "('partly_repainted', 'repainted_around', 'fully_repainted', 'accident_damaged', 'salvage')"


def conditions(s, d):
    c = F.col
    return facts(s, d).select("o_orderkey", D.chassis_condition(c("front"), c("rear"), c("chassis")).alias("chassis_condition"), D.paint_free(c("paint"), c("body")).alias("paint_free"), D.accident(c("crash"), c("body")).alias("accident"), D.offers(c("accepts"), c("swap")).alias("offers_swap"), D.search_text(c("front"), c("rear"), c("body")).alias("search_text"))


def specs(s, d):
    p = table(s, d, "part").select("p_partkey", "p_brand", "p_type", "p_size", F.substring("p_brand", 1, 7).alias("make"))
    rows = p.select(F.col("p_partkey").alias("listing_id"), F.col("make").alias("make_id"), F.col("p_brand").alias("model_id"), F.col("p_type").alias("trim_id"), F.when(F.col("p_partkey") % 5 == 0, F.col("p_size")).cast("int").alias("engine_cc"))
    trims = p.groupBy(F.col("p_brand").alias("model_id"), F.col("p_type").alias("trim_id")).agg(F.max(F.when(F.col("p_size") > 45, F.col("p_size"))).cast("int").alias("engine_cc"), F.max(F.when(F.col("p_size") % 2 == 0, "import")).alias("origin"))
    models = p.groupBy(F.col("p_brand").alias("model_id")).agg(F.max("p_size").cast("int").alias("engine_cc"), F.lit("local").alias("origin")).select("model_id", F.lit(None).cast("string").alias("trim_id"), "engine_cc", "origin")
    made = p.select(F.col("make").alias("make_id"), F.when(F.col("p_brand").endswith("1"), F.col("p_brand")).alias("model_id")).distinct().filter("model_id is not null or not endswith(make_id, '2')")
    return D.inherited_specs(rows, trims.unionByName(models), made.withColumn("country", F.coalesce("model_id", "make_id")))


SPECS_SQL = """WITH t AS (SELECT p_brand AS m, p_type AS t, max(p_size) FILTER (WHERE p_size > 45) AS cc, max('import') FILTER (WHERE p_size % 2 = 0) AS o FROM part GROUP BY 1, 2),
mo AS (SELECT p_brand AS m, max(p_size) AS cc FROM part GROUP BY 1), ag AS (SELECT * FROM mo WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.m = mo.m AND t.cc IS NOT NULL AND t.cc <> mo.cc)),
ck AS (SELECT DISTINCT left(p_brand, 7) AS k FROM part WHERE NOT ends_with(left(p_brand, 7), '2') AND NOT ends_with(p_brand, '1')), r AS (SELECT *, CASE WHEN p_partkey % 5 = 0 THEN p_size END AS own FROM part)
SELECT p_partkey AS listing_id, CAST(coalesce(own, t.cc, ag.cc) AS INT) AS engine_cc, CASE WHEN own IS NOT NULL THEN 'listing' WHEN t.cc IS NOT NULL THEN 'trim' WHEN ag.cc IS NOT NULL THEN 'model' END AS engine_source,
 coalesce(t.o, 'local') AS origin, CASE WHEN ends_with(p_brand, '1') THEN p_brand ELSE k END AS country, CASE WHEN ends_with(p_brand, '1') THEN 'model' WHEN k IS NOT NULL THEN 'make' END AS country_source
FROM r LEFT JOIN t ON t.m = p_brand AND t.t = p_type LEFT JOIN ag ON ag.m = p_brand LEFT JOIN ck ON k = left(p_brand, 7)"""


def marks(s, d):
    e = table(s, d, "customer").filter("c_custkey % 3 > 0")
    status = lambda x: F.get(F.array(*map(F.lit, ("active", "sold", "gone", "removed", "expired"))), (x % 5).cast("int"))
    m = e.select((F.col("c_custkey") % 100).alias("account_id"), F.col("c_custkey").alias("listing_id"), status(F.col("c_custkey")).alias("seen_status"), (F.col("c_custkey") % 4).cast("int").alias("status_version"))
    return D.status_notices(m, table(s, d, "customer").select(F.col("c_custkey").alias("listing_id"), status(F.floor(F.col("c_custkey") / 5)).alias("status")))


MARKS_SQL = """WITH m AS (SELECT c_custkey % 100 AS account_id, c_custkey AS listing_id, ['active', 'sold', 'gone', 'removed', 'expired'][CAST(c_custkey % 5 AS INT) + 1] AS old, ['active', 'sold', 'gone', 'removed', 'expired'][CAST(c_custkey // 5 % 5 AS INT) + 1] AS new, CAST(c_custkey % 4 AS INT) AS v FROM customer WHERE c_custkey % 3 > 0),
k AS (SELECT *, CASE WHEN old = 'active' AND new IN ('sold', 'gone', 'expired') THEN 'off_market' WHEN new = 'active' AND old IN ('sold', 'gone', 'expired') THEN 'relisted' END AS kind FROM m WHERE old <> new)
SELECT account_id, listing_id, new AS seen_status, v + CASE WHEN kind IS NULL THEN 0 ELSE 1 END AS status_version, kind FROM k"""


def predictions(s, d):
    return rated(s, d).filter("asking_price > 0").select("make_key", F.col("market_value").alias("predicted"), F.col("asking_price").alias("price"))


def answers(s, d):
    return table(s, d, "orders").select(F.when(F.col("o_orderkey") % 7 > 0, F.col("o_orderpriority")).alias("label"), F.when(F.col("o_orderkey") % 5 > 0, F.when(F.col("o_orderkey") % 3 == 0, "1-URGENT").otherwise(F.col("o_orderpriority"))).alias("answer"))


def by_words(s, d):
    rows = listings(s, d).withColumn("search_text", D.search_text(F.col("make_key"), F.col("body_type"), F.col("city")))
    return rows.filter(P.searchable(P.Search({"gearbox": ["O"]}, words="Stand NAT ۱۲"), P.Clock(NOW, YEAR_NOW))).select("listing_id", "search_text")


QUERIES = {
    "prd14_words": (by_words, LISTINGS_SQL + r"SELECT listing_id, concat_ws(' ', make_key, body_type, city) AS search_text FROM listings WHERE gearbox = 'O' AND regexp_matches(concat_ws(' ', make_key, body_type, city), '(?i)(^|[^a-z])stand') AND regexp_matches(concat_ws(' ', make_key, body_type, city), '(?i)(^|[^a-z])nat') AND regexp_matches(concat_ws(' ', make_key, body_type, city), '(^|[^0-9])12([^0-9]|$)')"),
    "ext01_attributes": (attributes, "SELECT o_orderkey, " + ", ".join(f"{sql_list(v)}[CAST(o_orderkey % {len(w)} AS INT) + 1] AS {k}" for k, (w, v) in WRITTEN.items()) + " FROM orders"),
    "agg22_field_tallies": (
        field_tallies,
        f"WITH r AS (SELECT CASE WHEN o_orderkey % 5 > 0 THEN {sql_list(WRITTEN['gearbox'][0])}[CAST(o_orderkey % 3 AS INT) + 1] END AS t, CASE WHEN o_orderkey % 5 = 0 THEN 'absent' WHEN o_orderkey % 3 = 2 THEN 'unparsed' ELSE 'value' END AS state FROM orders), c AS (SELECT state, t, count(*) AS n FROM r GROUP BY 1, 2) SELECT 'gearbox' AS field, state, CAST(sum(n) AS BIGINT) AS n, first(t ORDER BY n DESC, t) AS most_common FROM c GROUP BY state",
    ),
    "prj03_specs": (specs, SPECS_SQL),
    "prj05_conditions": (
        conditions,
        FACTS_SQL + f"""SELECT o_orderkey, CASE WHEN front = 'damaged' OR rear = 'damaged' OR chassis = 'damaged' THEN 'damaged' WHEN front = 'repainted' OR rear = 'repainted' THEN 'repainted' WHEN (front = 'intact' AND rear = 'intact') OR (front IS NULL AND rear IS NULL AND chassis = 'intact') THEN 'intact' END AS chassis_condition,
 CASE WHEN paint = 'spots' OR body IN {PAINTED} THEN false WHEN paint = 'none' OR body IN ('intact', 'minor_scratches') THEN true END AS paint_free, CASE WHEN crash = 'had_accident' OR body = 'salvage' THEN 'had_accident' WHEN crash = 'none' THEN 'none' END AS accident,
 CASE WHEN accepts OR swap = 'yes' THEN true WHEN NOT accepts OR swap = 'no' THEN false END AS offers_swap, concat_ws(' ', front, rear, body) AS search_text FROM f""",
    ),
    "prj09_km_per_year": (lambda s, d: listings(s, d).select("listing_id", D.km_per_year(F.col("mileage_km"), F.col("model_year"), YEAR_NOW).alias("km_per_year")), LISTINGS_SQL + f"SELECT listing_id, CAST(round(mileage_km / greatest({YEAR_NOW} - model_year, 0.5)) AS INT) AS km_per_year FROM listings"),
    "prj17_gauge": (
        lambda s, d: rated(s, d).filter("price_gap is not null").select("listing_id", D.gauge(F.col("price_gap").cast("double")).alias("g")).select("listing_id", F.round("g.share", 6).alias("share"), F.col("g.beyond").alias("beyond")),
        RATED_SQL + "SELECT listing_id, round((least(greatest(CAST(price_gap AS DOUBLE), -20), 20) + 20) / 40, 6) AS share, abs(price_gap) > 20 AS beyond FROM rated WHERE price_gap IS NOT NULL",
    ),
    "qry25_freshness_state": (lambda s, d: listings(s, d).groupBy(D.freshness_state(F.when(F.col("gearbox") == "O", "active").otherwise("sold"), F.col("last_seen_at").cast("timestamp_ntz"), now()).alias("state")).agg(F.count("*").alias("n")), LISTINGS_SQL + f"SELECT CASE WHEN gearbox IS DISTINCT FROM 'O' THEN 'off_market' WHEN last_seen_at IS NULL OR TIMESTAMP '{NOW}' - last_seen_at > INTERVAL 6 HOUR THEN 'stale' ELSE 'fresh' END AS state, count(*) AS n FROM listings GROUP BY 1"),
    "dat01_solar_year": (
        lambda s, d: table(s, d, "orders").groupBy(C.solar_day(F.col("o_orderdate").cast("date"))["year"].alias("year")).agg(F.count("*").alias("n")),
        "WITH o AS (SELECT CAST(o_orderdate AS DATE) AS d, CAST(year(o_orderdate) AS INT) AS y FROM orders) SELECT CAST(y - 621 - CASE WHEN d < make_date(y, 3, CASE WHEN y IN (1996, 2000, 2004) THEN 20 ELSE 21 END) THEN 1 ELSE 0 END AS INT) AS year, count(*) AS n FROM o GROUP BY 1",
    ),
    "join06_photos": (
        lambda s, d: D.with_photos(table(s, d, "orders").select(F.col("o_orderkey").alias("listing_id")), table(s, d, "lineitem").filter("l_tax > 0.02").select(F.col("l_orderkey").alias("listing_id"), F.col("l_linenumber").alias("position"), F.col("l_partkey").cast("string").alias("url"))),
        "SELECT o_orderkey AS listing_id, count(l_orderkey) AS photo_count, first(CAST(l_partkey AS VARCHAR) ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR)) AS cover FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_tax > 0.02 GROUP BY 1",
    ),
    "join16_demand": (
        lambda s, d: D.merged_counts(table(s, d, "events").filter("event_type = 'view'").groupBy("user_id").agg(F.count("*").alias("asked")), table(s, d, "events").filter("event_type = 'click'").groupBy("user_id").agg(F.count("*").alias("pasted")), ["user_id"]),
        "SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS asked, count(*) FILTER (WHERE event_type = 'click') AS pasted FROM events WHERE event_type IN ('view', 'click') GROUP BY 1",
    ),
    "win07_last_runs": (lambda s, d: D.last_of_day(table(s, d, "events").select("event_id", "user_id", tehran_day(F.col("ts")).alias("day")), "day", "event_id"), f"SELECT event_id, user_id, {DAY_SQL} AS day FROM events QUALIFY event_id = max(event_id) OVER (PARTITION BY {DAY_SQL})"),
    "srt10_backfill": (
        lambda s, d: D.quota(table(s, d, "orders").select(F.col("o_orderstatus").alias("priority"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("first_seen")), {"O": 5, "F": 3, "P": 2}, 200),
        "SELECT o_orderstatus AS priority, o_orderkey AS id, o_orderdate AS first_seen, CAST(row_number() OVER w AS INT) AS place FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) QUALIFY place <= CASE o_orderstatus WHEN 'O' THEN 100 WHEN 'F' THEN 60 WHEN 'P' THEN 40 END",
    ),
    "agg18_spread": (
        lambda s, d: D.spread(listings(s, d).filter("asking_price is not null"), ["make_key"], "asking_price").select("make_key", "n", F.round("centre", 4).alias("centre"), F.round("scale", 4).alias("scale")),
        LISTINGS_SQL + ", c AS (SELECT make_key, asking_price, median(asking_price) OVER (PARTITION BY make_key) AS centre FROM listings WHERE asking_price IS NOT NULL) SELECT make_key, count(*) AS n, round(any_value(centre), 4) AS centre, round(median(abs(asking_price - centre)) * 1.4826, 4) AS scale FROM c GROUP BY 1",
    ),
    "agg24_accuracy": (
        lambda s, d: D.accuracy(predictions(s, d), "make_key"),
        RATED_SQL + ", e AS (SELECT make_key, abs(market_value - asking_price) * 100 / asking_price AS e FROM rated WHERE asking_price > 0) SELECT make_key, count(*) AS tested, round(median(e), 2) AS mdape, round(count(*) FILTER (WHERE e <= 10) * 100 / count(*), 2) AS within_10 FROM e GROUP BY GROUPING SETS ((make_key), ())",
    ),
    "num12_class_scores": (
        lambda s, d: D.class_scores(answers(s, d), "label", "answer").select("value", "labelled", "answered", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall")),
        "WITH a AS (SELECT CASE WHEN o_orderkey % 7 > 0 THEN o_orderpriority END AS l, CASE WHEN o_orderkey % 5 > 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN '1-URGENT' ELSE o_orderpriority END END AS a FROM orders), v AS (SELECT l AS v FROM a WHERE l IS NOT NULL UNION SELECT a FROM a WHERE a IS NOT NULL), c AS (SELECT v, (SELECT count(*) FROM a WHERE l = v) AS labelled, (SELECT count(*) FROM a WHERE a = v) AS answered, (SELECT count(*) FROM a WHERE a = v AND l = v) AS b FROM v) SELECT v AS value, labelled, answered, CASE WHEN answered > 0 THEN round(b / answered, 9) END AS precision, CASE WHEN labelled > 0 THEN round(b / labelled, 9) END AS recall FROM c",
    ),
    "num13_nice_step": (lambda s, d: table(s, d, "part").select("p_partkey", D.nice_step(F.col("p_retailprice") / 7).alias("step")), "WITH r AS (SELECT p_partkey, p_retailprice / 7 AS x FROM part), p AS (SELECT *, power(10, floor(log10(x))) AS w FROM r) SELECT p_partkey, w * CASE WHEN x / w <= 1 THEN 1 WHEN x / w <= 2 THEN 2 WHEN x / w <= 2.5 THEN 2.5 WHEN x / w <= 5 THEN 5 ELSE 10 END AS step FROM p"),
    "num14_seeded_split": (
        lambda s, d: table(s, d, "supplier").select("s_suppkey", (D.lcg_share(F.col("s_suppkey"), 51) < 0.8).alias("learn")),
        "WITH RECURSIVE g AS (SELECT 0 AS i, CAST(51 AS HUGEINT) AS s UNION ALL SELECT i + 1, (s * 1664525 + 1013904223) % 4294967296 FROM g WHERE i < (SELECT max(s_suppkey) FROM supplier)) SELECT s_suppkey, s / 4294967296.0 < 0.8 AS learn FROM supplier JOIN g ON i = s_suppkey",
    ),
    "stm12_status_notices": (marks, MARKS_SQL),
    "stm20_demand": (lambda s, d: table(s, d, "events").groupBy(tehran_day(F.col("ts")).alias("day"), "user_id", "event_type").agg(F.count("*").alias("n")), f"SELECT {DAY_SQL} AS day, user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2, 3"),
    "prd16_names": (lambda s, d: table(s, d, "part").filter(D.contains_any("eD w", "p_brand", "p_name") | D.contains_any("_", "p_type", "p_name")).select("p_partkey"), "SELECT p_partkey FROM part WHERE p_brand ILIKE '%ed w%' OR p_name ILIKE '%ed w%' OR p_type ILIKE '%!_%' ESCAPE '!' OR p_name ILIKE '%!_%' ESCAPE '!'"),
}

"""Registered queries of search and market: filters, orders, pages, facets, joins, aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from mizan.operators import market as M
from mizan.operators import paging as G
from mizan.operators import predicates as P
from mizan.plans.listing import LISTINGS_SQL, NOW, RATED_SQL, YEAR_NOW, listings, now, rated
from mizan.session import table

CLOCK = P.Clock(NOW, YEAR_NOW)
NOW_SQL = f"TIMESTAMP '{NOW}'"
#: A search with one filter of most kinds.
SEARCH = P.Search({"price": {"max": 60_000}, "gearbox": ["F", "O"], "deal": "good", "no_accident": True, "mileage": {"max": 160_000}})
SEARCH_SQL = {
    "mileage": "mileage_km IS NOT NULL AND mileage_km <= 160000", "price": "asking_price IS NOT NULL AND asking_price <= 60000",
    "deal": "coalesce(rating IN ('great', 'good'), false)", "gearbox": "coalesce(gearbox IN ('F', 'O'), false)", "no_accident": "accident IS DISTINCT FROM 'had_accident'",
}
ALL_SQL = " AND ".join(SEARCH_SQL.values())
ORDERS_SQL = {k: ", ".join(f"{c} {'ASC' if up else 'DESC'} NULLS LAST" for c, up in G.terms(k)) for k in G.SORTS}
PAGE_COLUMNS = "listing_id, model_key, model_year, mileage_km, asking_price, market_value, CAST(price_gap AS DOUBLE) AS price_gap, rating"


def full(spark, d):
    return rated(spark, d)


def shown(df):
    return df.select("listing_id", "model_key", "model_year", "mileage_km", "asking_price", "market_value", F.col("price_gap").cast("double").alias("price_gap"), "rating")


def ids(df):
    """How many rows were kept, by make: enough to tell two conditions apart, and small."""
    return df.groupBy("make_key").agg(F.count("*").alias("n"), F.sum("asking_price").alias("total"), F.min("listing_id").alias("first_id"))


def ids_sql(where, source="rated", base=RATED_SQL):
    return f"{base} SELECT make_key, count(*) AS n, CAST(sum(asking_price) AS BIGINT) AS total, min(listing_id) AS first_id FROM {source} WHERE {where} GROUP BY make_key"


#: Each predicate kind: its condition, and the same in SQL.
PREDICATES = {
    "prd01_one_of": (lambda: P.one_of("fuel", ["N", "R"]), "fuel IN ('N', 'R')"),
    "prd02_between": (lambda: P.between("asking_price", 20_000, 40_000), "asking_price BETWEEN 20000 AND 40000"),
    "prd02_open_range": (lambda: P.between("mileage_km"), "mileage_km IS NOT NULL"),
    "prd03_at_least": (lambda: P.at_least("insurance_months", 3), "insurance_months >= 3"),
    "prd04_at_most": (lambda: P.at_most("mileage_km", 50_000), "mileage_km <= 50000"),
    "prd06_is_not": (lambda: P.is_not("accident", "had_accident"), "accident IS DISTINCT FROM 'had_accident'"),
    "prd07_within_days": (lambda: P.within_days("listed_at", 400, now()), f"listed_at >= {NOW_SQL} - INTERVAL 400 DAY"),
    "prd08_years_old": (lambda: P.years_old_at_most("model_year", 2, YEAR_NOW), f"model_year >= {YEAR_NOW - 2}"),
    "prd09_mileage_for_age": (lambda: P.mileage_for_age_at_most("mileage_km", "model_year", 12_000, YEAR_NOW), f"mileage_km <= 12000 * greatest({YEAR_NOW} - model_year, 0.5) AND model_year IS NOT NULL"),
    "prd10_ranked": (lambda: P.ranked("rating", P.RATINGS, "fair"), "rating IN ('great', 'good', 'fair')"),
    "prd11_fresh": (lambda: P.is_fresh("last_seen_at", 24 * 90, now()), f"last_seen_at >= {NOW_SQL} - INTERVAL 2160 HOUR"),
    "prd13_all": (lambda: P.searchable(SEARCH, CLOCK), ALL_SQL),
    "prd15_under_key": (lambda: P.under("model_key", "Brand#11"), "(model_key = 'Brand#11' OR starts_with(model_key, 'Brand#11.'))"),
}


def _predicate(make):
    return lambda s, d: ids(full(s, d).filter(make()))


def _catalogue(name):
    def run(s, d):
        search = P.CATALOGUES[name]
        return shown(G.page(full(s, d).filter(P.searchable(search, CLOCK)), search.sort))

    return run


_LOW_KM = f"coalesce(mileage_km <= 12000 * greatest({YEAR_NOW} - model_year, 0.5) AND model_year IS NOT NULL, false)"
_CATALOGUE_SQL = {
    "expert_pick": f"rating IN ('great', 'good') AND accident IS DISTINCT FROM 'had_accident' AND {_LOW_KM}",
    "great_deals": "rating = 'great' AND asking_price <= 50000",
    "clean_and_easy": "accident IS DISTINCT FROM 'had_accident' AND rating IN ('great', 'good', 'fair') AND photo_count >= 1",
    "family": f"body_type IN ('PROMO', 'STANDARD') AND model_year >= {YEAR_NOW - 4}",
    "low_mileage": _LOW_KM,
    "automatic": "gearbox = 'O' AND rating IN ('great', 'good', 'fair')",
    "ride_hailing": f"asking_price <= 30000 AND model_year >= {YEAR_NOW - 5} AND fuel IN ('N', 'R')",
    "insured": "insurance_months >= 4 AND asking_price >= 1",
    "newest": f"listed_at >= {NOW_SQL} - INTERVAL 300 DAY",
}
#: A page's end somewhere in the middle, for keyset pages.
KEY = {"price_gap": "-12.50", "listed_at": "1998-06-01 00:00:00", "listing_id": "5", "asking_price": 40_000, "mileage_km": 100_000, "model_year": 1998}


def _keyset(sort):
    def run(s, d):
        typed = {"price_gap": "decimal(9,2)", "listed_at": "timestamp_ntz"}
        key = {c: F.lit(KEY[c]).cast(typed[c]) if c in typed else KEY[c] for c, _ in G.terms(sort)}
        return shown(G.page(full(s, d), sort, key))

    return run


def _keyset_sql(sort):
    typed = {"price_gap": "CAST(-12.50 AS DECIMAL(9,2))", "listed_at": "TIMESTAMP '1998-06-01 00:00:00'", "listing_id": "'5'"}
    ways, equal = [], "true"
    for c, up in G.terms(sort):
        v = typed.get(c, str(KEY[c]))
        ways.append(f"({equal} AND ({c} {'>' if up else '<'} {v} OR {c} IS NULL))")
        equal += f" AND {c} = {v}"
    return f"{RATED_SQL} SELECT {PAGE_COLUMNS} FROM rated WHERE {' OR '.join(ways)} ORDER BY {ORDERS_SQL[sort]} LIMIT 24"


def facets_sql():
    out = []
    for f, c in G.FACETS.items():
        others = " AND ".join(v for k, v in SEARCH_SQL.items() if k != f)
        out.append(f"SELECT '{f}' AS facet, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM rated WHERE {others} AND {c} IS NOT NULL GROUP BY {c}")
    return RATED_SQL + " UNION ALL ".join(out)


def totals_sql():
    sums = {"total": "true", "seen": f"last_seen_at >= {NOW_SQL} - INTERVAL 48 HOUR"} | _CATALOGUE_SQL
    return RATED_SQL + " UNION ALL ".join(f"SELECT '{k}' AS facet, count(*) FILTER (WHERE {v}) AS n FROM rated" for k, v in sums.items())


def unknown_sql():
    out = []
    for i in ("mileage", "price", "deal"):
        others = " AND ".join(v for k, v in SEARCH_SQL.items() if k != i)
        out.append(f"SELECT '{i}' AS filter, count(*) FILTER (WHERE {others} AND {P.FILTERS[i].column} IS NULL) AS n FROM rated")
    return RATED_SQL + " UNION ALL ".join(out)


def relaxed_sql():
    out = []
    for i in SEARCH_SQL:
        others = " AND ".join(v for k, v in SEARCH_SQL.items() if k != i)
        out.append(f"SELECT '{i}' AS filter, count(*) FILTER (WHERE {others}) AS n FROM rated")
    return f"{RATED_SQL} SELECT * FROM ({' UNION ALL '.join(out)}) WHERE n > 0 ORDER BY n DESC, filter LIMIT 3"


OPTIONS = ["make_key", "body_type", "fuel", "gearbox", "seller_type", "source_id", "city", "model_year"]


def subjects(spark, d):
    return listings(spark, d).filter("price_type = 'negotiable' AND seller_type = 'dealer'")


def overview_sql():
    q = ", ".join(f"round(quantile_cont(asking_price, {v}), 4) AS price_{k}" for k, v in {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}.items())
    r = ", ".join(f"count(*) FILTER (WHERE rating = '{x}') AS n_{x}" for x in P.RATINGS)
    return f"""{RATED_SQL} SELECT model_key, count(*) AS n, count(asking_price) AS n_priced, min(asking_price) AS least_price, max(asking_price) AS most_price, {q},
 round(quantile_cont(mileage_km, 0.5), 4) AS median_km, {r}, count(accident) AS accident_known, count(*) FILTER (WHERE accident = 'had_accident') AS accident_yes FROM rated GROUP BY model_key"""


def trend(s, d):
    return M.daily_trend(listings(s, d))


TREND_SQL = LISTINGS_SQL + """, trend AS (SELECT make_key, CAST(listed_at AS DATE) AS day, count(*) AS n, round(quantile_cont(asking_price, 0.25), 4) AS price_p25,
 round(quantile_cont(asking_price, 0.5), 4) AS price_p50, round(quantile_cont(asking_price, 0.75), 4) AS price_p75 FROM listings WHERE asking_price IS NOT NULL GROUP BY 1, 2)"""
WEEK_SQL = "day - CAST((dayofweek(day) + 1) % 7 AS INT)"


def facts(s, d):
    rows = listings(s, d)
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("fuel", "gearbox", "accident")])
    return rows.select("model_key", F.explode(pairs).alias("f")).select("model_key", "f.field", "f.value")


QUERIES = {
    "qry01_search_page": (lambda s, d: shown(G.page(full(s, d).filter(P.searchable(SEARCH, CLOCK)), "best_deal")), f"{RATED_SQL} SELECT {PAGE_COLUMNS} FROM rated WHERE {ALL_SQL} ORDER BY {ORDERS_SQL['best_deal']} LIMIT 24"),
    **{k: (_predicate(make), ids_sql(sql)) for k, (make, sql) in PREDICATES.items()},
    **{f"srt01_{k}": ((lambda s, d, k=k: shown(G.page(full(s, d), k))), f"{RATED_SQL} SELECT {PAGE_COLUMNS} FROM rated ORDER BY {ORDERS_SQL[k]} LIMIT 24") for k in G.SORTS},
    **{f"srt03_keyset_{k}": (_keyset(k), _keyset_sql(k)) for k in G.SORTS},
    **{f"cat_{k}": (_catalogue(k), f"{RATED_SQL} SELECT {PAGE_COLUMNS} FROM rated WHERE {v} ORDER BY {ORDERS_SQL[P.CATALOGUES[k].sort]} LIMIT 24") for k, v in _CATALOGUE_SQL.items()},
    "agg13_facets": (lambda s, d: G.facets(full(s, d), SEARCH, CLOCK), facets_sql()),
    "agg14_capped_count": (lambda s, d: G.capped_count(full(s, d).filter(P.searchable(SEARCH, CLOCK)), 500), f"{RATED_SQL} SELECT least(count(*), 500) AS n, count(*) <= 500 AS exact FROM rated WHERE {ALL_SQL}"),
    "agg15_unknown_counts": (lambda s, d: G.unknown_counts(full(s, d), SEARCH, CLOCK, ("mileage", "price", "deal")), unknown_sql()),
    "agg16_facet_totals": (lambda s, d: G.facet_totals(full(s, d), CLOCK), totals_sql()),
    "qry18_relaxed": (lambda s, d: G.relaxed(full(s, d), SEARCH, CLOCK), relaxed_sql()),
    "agg07_option_counts": (lambda s, d: G.option_counts(listings(s, d), OPTIONS), LISTINGS_SQL + " UNION ALL ".join(f"SELECT '{c}' AS dimension, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM listings WHERE {c} IS NOT NULL GROUP BY {c}" for c in OPTIONS)),
    "win01_popular_models": (
        lambda s, d: G.with_model_rank(listings(s, d)).filter(F.col("model_rank") <= P.POPULAR_RANK).groupBy("model_key", "model_rank").agg(F.count("*").alias("n")),
        LISTINGS_SQL + ", m AS (SELECT model_key, count(*) AS n, CAST(rank() OVER (ORDER BY count(*) DESC) AS INT) AS model_rank FROM listings GROUP BY model_key) SELECT * FROM m WHERE model_rank <= 15",
    ),
    "join03_comparables": (
        lambda s, d: M.near_rows(listings(s, d), subjects(s, d)),
        LISTINGS_SQL + """, a AS (SELECT * FROM listings WHERE price_type = 'negotiable' AND seller_type = 'dealer' AND model_year IS NOT NULL AND mileage_km IS NOT NULL),
c AS (SELECT a.listing_id, b.listing_id AS comparable_id, round(abs(b.model_year - a.model_year) + abs(b.mileage_km - a.mileage_km) / 50000, 6) AS distance, b.asking_price
 FROM a JOIN listings b ON a.model_id = b.model_id AND a.listing_id <> b.listing_id WHERE b.model_year IS NOT NULL AND b.mileage_km IS NOT NULL AND b.asking_price IS NOT NULL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY listing_id ORDER BY distance, comparable_id) AS INT) AS position FROM c)
SELECT listing_id, position, comparable_id, distance, asking_price FROM r WHERE position <= 10""",
    ),
    "join08_near_years": (
        lambda s, d: M.near_year_counts(listings(s, d)),
        LISTINGS_SQL + ", y AS (SELECT model_id, model_year, count(*) AS n FROM listings WHERE model_year IS NOT NULL GROUP BY 1, 2) SELECT model_id, model_year, n, CAST(sum(n) OVER (PARTITION BY model_id ORDER BY model_year RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS BIGINT) AS near FROM y",
    ),
    "val02_price_outliers": (
        lambda s, d: M.price_outliers(listings(s, d), factor=1.5).filter("is_outlier").select("listing_id", "model_id", "model_year", "asking_price", F.round("near_median", 4).alias("near_median")),
        LISTINGS_SQL + """, p AS (SELECT * FROM listings WHERE model_year IS NOT NULL AND asking_price IS NOT NULL),
m AS (SELECT y.model_id, y.model_year, count(*) FILTER (WHERE abs(p.model_year - y.model_year) <= 2) AS k, quantile_cont(p.asking_price, 0.5) FILTER (WHERE abs(p.model_year - y.model_year) <= 2) AS close, quantile_cont(p.asking_price, 0.5) AS whole
 FROM (SELECT DISTINCT model_id, model_year FROM p) y JOIN p ON p.model_id = y.model_id GROUP BY 1, 2),
u AS (SELECT model_id, model_year, CASE WHEN k >= 3 THEN close ELSE whole END AS near_median FROM m)
SELECT listing_id, model_id, model_year, asking_price, round(near_median, 4) AS near_median FROM p JOIN u USING (model_id, model_year) WHERE asking_price > near_median * 1.5 OR asking_price * 1.5 < near_median""",
    ),
    "win04_first_of_reposts": (
        lambda s, d: M.first_of_reposts(listings(s, d).filter("asking_price is not null"), ["source_id", "model_key", "model_year"], [F.asc("listed_at"), F.asc("listing_id")]).select("source_id", "model_key", "model_year", "listing_id"),
        LISTINGS_SQL + "SELECT source_id, model_key, model_year, listing_id FROM listings WHERE asking_price IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_id, model_key, model_year ORDER BY listed_at, listing_id) = 1",
    ),
    "join11_latest": (lambda s, d: M.latest(listings(s, d), "model_id", "last_seen_at", "listing_id"), LISTINGS_SQL + "SELECT model_id, listing_id FROM listings QUALIFY row_number() OVER (PARTITION BY model_id ORDER BY last_seen_at DESC, listing_id DESC) = 1"),
    "join17_deep_prefix": (
        lambda s, d: M.longest_prefix(listings(s, d).select(F.concat_ws(".", "trim_key", "fuel", "gearbox", "accident", "city", F.lit("x"), F.lit("y")).alias("key")).distinct(), listings(s, d).filter("gearbox = 'O'").select(F.concat_ws(".", "trim_key", "fuel", "gearbox", "accident", "city", F.lit("x")).alias("name"))),
        LISTINGS_SQL + ", k AS (SELECT DISTINCT concat_ws('.', trim_key, fuel, gearbox, accident, city, 'x') AS b, gearbox FROM listings) SELECT b || '.y' AS key, CASE WHEN bool_or(gearbox = 'O') THEN b END AS name FROM k GROUP BY b",
    ),
    "join17_longest_prefix": (
        lambda s, d: M.longest_prefix(listings(s, d).select(F.col("trim_key").alias("key")).distinct(), listings(s, d).filter("model_key like '%PROMO'").select(F.col("model_key").alias("name")).union(listings(s, d).select("make_key"))),
        LISTINGS_SQL + "SELECT DISTINCT trim_key AS key, CASE WHEN body_type = 'PROMO' THEN model_key ELSE make_key END AS name FROM listings",
    ),
    "join10_scopes": (
        lambda s, d: M.under_scopes(listings(s, d), s.sql("SELECT 'Brand#11' AS scope UNION ALL SELECT 'Brand#12.PROMO' UNION ALL SELECT cast(null as string)"), "trim_key").groupBy("scope").agg(F.count("*").alias("n")),
        LISTINGS_SQL + "SELECT s.scope, count(*) AS n FROM (SELECT 'Brand#11' AS scope UNION ALL SELECT 'Brand#12.PROMO' UNION ALL SELECT NULL) s JOIN listings ON s.scope IS NULL OR trim_key = s.scope OR starts_with(trim_key, s.scope || '.') GROUP BY 1",
    ),
    "qry04_model_overview": (lambda s, d: M.model_overview(full(s, d)), overview_sql()),
    "qry04_model_years": (lambda s, d: M.model_years(listings(s, d)), LISTINGS_SQL + "SELECT model_key, model_year, count(*) AS n, round(quantile_cont(asking_price, 0.5), 4) AS median_price, round(quantile_cont(mileage_km, 0.5), 4) AS median_km FROM listings WHERE model_year IS NOT NULL GROUP BY 1, 2"),
    "agg27_modal_year": (lambda s, d: M.modal_year(M.model_years(listings(s, d))), LISTINGS_SQL + "SELECT model_key, model_year, count(*) AS n FROM listings WHERE model_year IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY model_key ORDER BY count(*) DESC, model_year DESC) = 1"),
    "qry06_daily_trend": (trend, TREND_SQL + "SELECT * FROM trend"),
    "agg26_weekly_points": (lambda s, d: M.weekly_points(trend(s, d)), TREND_SQL + f"SELECT make_key, CAST({WEEK_SQL} AS DATE) AS week, day, n, price_p50 FROM trend WHERE n >= 2 QUALIFY row_number() OVER (PARTITION BY make_key, week ORDER BY day DESC) = 1"),
    "agg25_trend_change": (
        lambda s, d: M.trend_change(trend(s, d), 30),
        TREND_SQL + "SELECT a.make_key, a.day, b.day AS before_day, round((a.price_p50 / b.price_p50 - 1) * 100, 4) AS change FROM trend a JOIN trend b ON a.make_key = b.make_key AND b.day BETWEEN a.day - 34 AND a.day - 26 QUALIFY row_number() OVER (PARTITION BY a.make_key, a.day ORDER BY abs((a.day - b.day) - 30), b.day DESC) = 1",
    ),
    "join05_top_per_source": (
        lambda s, d: M.top_per(listings(s, d), "source_id", [F.desc("listed_at"), F.desc("listing_id")], 20).select("source_id", "position", "listing_id"),
        LISTINGS_SQL + "SELECT source_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY listed_at DESC, listing_id DESC) AS INT) AS position, listing_id FROM listings QUALIFY position <= 20",
    ),
    "agg23_mode": (lambda s, d: M.mode_of(listings(s, d), "make_key", "city"), LISTINGS_SQL + "SELECT make_key, city, count(*) AS n FROM listings WHERE city IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY make_key ORDER BY count(*) DESC, city) = 1"),
    "agg08_source_rollup": (
        lambda s, d: M.source_status(listings(s, d), now()),
        LISTINGS_SQL + f", a AS (SELECT *, greatest(epoch({NOW_SQL} - last_seen_at) / 60, 0) AS age FROM listings) SELECT source_id, CAST(grouping(source_id) AS INT) AS is_total, count(*) AS n, count(*) FILTER (WHERE age <= 2880) AS fresh, count(DISTINCT model_key) AS models, CAST(round(quantile_cont(age, 0.5)) AS BIGINT) AS median_minutes, round(avg(asking_price), 2) AS mean_price FROM a GROUP BY ROLLUP (source_id)",
    ),
    "agg12_pivot": (lambda s, d: M.pivot_facts(facts(s, d), "model_key", ["fuel", "gearbox", "accident"]), LISTINGS_SQL + "SELECT model_key, max(fuel) AS fuel, max(gearbox) AS gearbox, max(accident) AS accident FROM listings GROUP BY 1"),
    "agg10_aliases": (lambda s, d: M.aliases(listings(s, d), "make_key", "body_type"), LISTINGS_SQL + "SELECT make_key, string_agg(DISTINCT body_type, ' ' ORDER BY body_type) AS words FROM listings GROUP BY 1"),
    "src02_chunk_bounds": (lambda s, d: M.chunk_bounds(listings(s, d), "listing_id", 1000), LISTINGS_SQL + ", n AS (SELECT listing_id, row_number() OVER (ORDER BY listing_id) AS n FROM listings) SELECT listing_id, n FROM n WHERE n % 1000 = 1"),
    "prd17_semi": (lambda s, d: table(s, d, "customer").join(table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").groupBy("c_mktsegment").agg(F.count("*").alias("n")), "SELECT c_mktsegment, count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) GROUP BY 1"),
    "join14_anti": (
        lambda s, d: table(s, d, "customer").join(table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("n")),
        "SELECT c_mktsegment, count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) GROUP BY 1",
    ),
}

"""Registered queries of stated numbers and rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from mizan.functions import reading as R
from mizan.functions.wording import mileage_wording
from mizan.plans.listing import LISTINGS_SQL, YEAR_NOW, listings
from mizan.session import table


def years(s, d):
    k = table(s, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 900 + 1250).cast("int").alias("y"))
    alone, both = R.year_stated_alone(F.col("y")), R.years_stated_together(F.col("y"), F.col("y") + 620 + (F.col("o_orderkey") % 4).cast("int"))
    return k.select("o_orderkey", alone["written"].alias("written"), alone["sh"].alias("sh"), alone["ad"].alias("ad"), both["sh"].alias("both_sh"), both["ad"].alias("both_ad"))


#: What sellers write about a figure n, k being 1,000 times it and g the same in groups: fixed values of both forms.
SAID = [
    "صفر خشک تحویل", "ماشین صفر است", "بدون کار کرد", "حرکت نداشته", "صفر کیلو متر", "در حد صفر", "موتور صفر", "{n} کیلومتر", "کارکرد {n} هزار", "{n} هزار تومان تخفیف",
    "{n} دونه کار", "کارکرد: {n} دانه", "{n} کارکرد واقعی", "{n} کیلو راه رفته", "{n} تا کیلومتر انداخته", "کارکرد {k}", "{g} کیلومتر", "قیمت {g} تومان", "{k} کیلومتر، صفر خشک", "روغن 5 کیلومتر پیش", "{n}هزار کیلومتر", "km {k}", "کارکرده {k} تومان", "سالم",
]


def said(s, d):
    """Orders as texts about a figure, in Persian digits for every third."""
    n = (F.col("o_orderkey") % 900 + 1).cast("int")
    k = table(s, d, "orders").select("o_orderkey", n.alias("n"), F.get(F.array(*map(F.lit, SAID)), (F.floor(F.col("o_orderkey") / 5) % len(SAID)).cast("int")).alias("t"))
    filled = F.replace(F.replace(F.replace("t", F.lit("{n}"), F.col("n").cast("string")), F.lit("{k}"), (F.col("n") * 1000).cast("string")), F.lit("{g}"), F.format_number(F.col("n") * 1000, 0))
    return k.select("o_orderkey", "n", F.when(F.col("o_orderkey") % 3 == 0, F.translate(filled, "0123456789", "۰۱۲۳۴۵۶۷۸۹")).otherwise(filled).alias("t"))


_KM, _DRIVEN, _NEAR = "(کیلومتر|کیلومتری)", "(کارکرد|کارکرده)", "(کارکرد|کارکرده|کیلومتر|کیلومتری|کیلو|km)"
_LOW = ["' صفر (خشک|کیلومتر|کیلومتری|کیلو|km) '", "' (ماشین|خودرو|خودروی|اتومبیل) صفر '", f"' بدون {_DRIVEN} '", "' حرکت نداشته '", f"' ' || n || ' {_KM} '", f"' ' || n || ' (دونه|دانه) (کارکرد|کارکرده|کار|کیلومتر|کیلومتری) '", f"' {_DRIVEN} ' || n || ' (دونه|دانه) '", f"' ' || n || ' {_DRIVEN} (واقعی|حقیقی) '", "' ' || n || ' ((کیلو|km) )?راه رفته '"]
_HIGH = ["' ' || n || ' هزار '", "' ' || n || ' تا (کارکرد|کارکرده|کار|کیلومتر|کیلومتری|کیلو|km|انداخته) '", f"' {_NEAR} ' || n * 1000 || ' '", f"' ' || n * 1000 || ' {_NEAR} '"]
_PAID = "(تومان|تومن|ریال|میلیون|تخفیف) "
WORDING_SQL = rf"""WITH s AS (SELECT o_orderkey, CAST(o_orderkey % 900 + 1 AS INT) AS n, {[*SAID]}[CAST(o_orderkey // 5 % {len(SAID)} AS INT) + 1] AS t FROM orders),
f AS (SELECT o_orderkey, n, replace(replace(replace(t, '{{n}}', CAST(n AS VARCHAR)), '{{k}}', CAST(n * 1000 AS VARCHAR)), '{{g}}', CAST(n AS VARCHAR) || ',000') AS t FROM s),
w AS (SELECT o_orderkey, n, ' ' || regexp_replace(regexp_replace(regexp_replace(replace(lower(t), ',000', '000'), '([\p{{L}}])([0-9])', '\1 \2', 'g'), '([0-9])([\p{{L}}])', '\1 \2', 'g'), '[^\p{{L}}\p{{N}}]+', ' ', 'g') || ' ' AS t FROM f),
j AS (SELECT o_orderkey, n, replace(replace(t, ' کیلو متر ', ' کیلومتر '), ' کار کرد ', ' کارکرد ') AS t FROM w),
m AS (SELECT o_orderkey, {" OR ".join(f"regexp_matches(t, {p})" for p in _LOW)} AS low, {" OR ".join(f"(regexp_matches(t, {p}) AND NOT regexp_matches(t, {p} || '{_PAID}'))" for p in _HIGH)} AS high FROM j)
SELECT o_orderkey, CASE WHEN low AND NOT high THEN 'really_low' WHEN high AND NOT low THEN 'thousands_text' END AS reading FROM m"""

QUERIES = {
    "ext12_wordings": (lambda s, d: said(s, d).select("o_orderkey", mileage_wording(F.col("t"), F.col("n"))["reading"].alias("reading")), WORDING_SQL),
    "num07_stated_years": (
        years,
        """WITH k AS (SELECT o_orderkey, CAST(o_orderkey % 900 + 1250 AS INT) AS y, CAST(o_orderkey % 900 + 1870 + o_orderkey % 4 AS INT) AS z FROM orders),
 b AS (SELECT *, y BETWEEN 1300 AND 1500 AS solar, y BETWEEN 1921 AND 2121 AS greg, y BETWEEN 1300 AND 1500 AND z BETWEEN 1921 AND 2121 AND z - y BETWEEN 621 AND 622 AS pair FROM k)
 SELECT o_orderkey, CASE WHEN solar THEN 'sh' WHEN greg THEN 'ad' END AS written, CASE WHEN solar THEN y WHEN greg THEN y - 621 END AS sh, CASE WHEN greg AND NOT solar THEN y END AS ad, CASE WHEN pair THEN y END AS both_sh, CASE WHEN pair THEN z END AS both_ad FROM b""",
    ),
    "num08_implausible_mileage": (
        lambda s, d: listings(s, d).filter(R.implausible_mileage((F.col("mileage_km") / 20).cast("int"), YEAR_NOW - F.col("model_year"))).groupBy("model_key").agg(F.count("*").alias("n")),
        LISTINGS_SQL + f"SELECT model_key, count(*) AS n FROM listings WHERE CAST(trunc(mileage_km / 20) AS INT) < 1000 AND {YEAR_NOW} - model_year >= 3 GROUP BY 1",
    ),
    "num11_wilson": (
        lambda s, d: listings(s, d).groupBy("model_key").agg(F.count_if(F.col("accident") == "none").alias("yes"), F.count("accident").alias("known")).withColumn("w", R.wilson(F.col("yes"), F.col("known"))).select("model_key", F.round("w.low", 9).alias("low"), F.round("w.high", 9).alias("high")),
        LISTINGS_SQL + f""", c AS (SELECT model_key, count(*) FILTER (WHERE accident = 'none') AS yes, count(accident) AS n FROM listings GROUP BY 1), z AS (SELECT *, yes / n AS p, {R.Z95} AS z FROM c)
 SELECT model_key, CASE WHEN n = 0 THEN 0 ELSE round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 9) END AS low, CASE WHEN n = 0 THEN 1 ELSE round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 9) END AS high FROM z""",
    ),
}

"""Notices about marked listings: asking prices that fall, listings that leave the market and those that come back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Statuses of a listing that has left the market by itself. `removed`, taken down, announces nothing.
ON, OFF = "active", ("sold", "expired", "gone")
#: Days without an event after which a mark starts anew: what was seen before is forgotten.
LAPSE_DAYS = 30


def followed(events: DataFrame, marks: DataFrame) -> DataFrame:
    """Each event of a listing for each account that marked it: an equi-join on the listing."""
    some = events.filter("listing_id is not null and observed_at is not null")
    return some.join(marks.select("account", "listing_id", "marked_at"), "listing_id")


def told_of(notable: DataFrame, marks: DataFrame) -> DataFrame:
    """Each notable event of a listing for each account that had marked it before: an equi-join on the listing."""
    own = marks.groupBy("account", "listing_id").agg(F.min("marked_at").alias("marked_at"))
    return followed(notable, own).filter("observed_at > marked_at")


def announced(before: Column, after: Column) -> Column:
    """off_market or relisted; null for any other change of status."""
    return F.when((before == ON) & after.isin(*OFF), "off_market").when(before.isin(*OFF) & (after == ON), "relisted")


def mark_notices(events: DataFrame, marks: DataFrame, lapse_days: int = LAPSE_DAYS) -> DataFrame:
    """(account, listing_id, at, kind, version, previous_price, price) of events(listing_id, observed_at, status,
    price_type, asking_price) after marks(account, listing_id, marked_at) were set.

    kind: `price_drop`, an asking price under the last one, whatever stood between; `off_market` and `relisted`, with a
    version that counts a mark's announced changes. Events before the mark tell nobody but are what later ones are
    compared with. After more than lapse_days without an event a mark starts anew. Events of one instant go by status,
    type and price; repeated events tell nothing twice. What an event is compared with is the listing's own, whoever
    marked it: one sort by listing, and only events that announce something meet marks. A mark set twice is the earlier.
    """
    by = ["listing_id"]
    some = events.filter("listing_id is not null and observed_at is not null")
    order = ["observed_at", "status", "price_type", F.col("asking_price").asc_nulls_first()]
    w = Window.partitionBy(*by).orderBy(*order)
    late = F.col("observed_at") > F.lag("observed_at").over(w) + F.make_interval(days=F.lit(lapse_days))
    seen = some.withColumns({"__new": F.coalesce(late, F.lit(False)).cast("int"), "__place": F.row_number().over(w)})
    seen = seen.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy(*by, "__run").orderBy(*order)
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    asked = F.when(F.col("price_type") == "asking", F.col("asking_price"))
    seen = seen.withColumns({"__last": F.last(asked, ignorenulls=True).over(before), "__change": announced(F.lag("status").over(own), F.col("status"))})
    drop = F.coalesce(asked < F.col("__last"), F.lit(False))
    seen = told_of(seen.filter(drop | F.col("__change").isNotNull()), marks)
    counted = Window.partitionBy("account", "listing_id", "__run").orderBy("__place").rowsBetween(Window.unboundedPreceding, 0)
    seen = seen.withColumn("version", F.count("__change").over(counted).cast("int"))
    price = F.when(drop, F.struct(F.lit("price_drop").alias("kind"), F.lit(None).cast("int").alias("version"), F.col("__last").alias("previous_price"), F.col("asking_price").alias("price")))
    status = F.when(F.col("__change").isNotNull(), F.struct(F.col("__change").alias("kind"), F.col("version"), F.lit(None).cast("long").alias("previous_price"), F.when(F.col("__change") == "relisted", asked).alias("price")))
    each = seen.select("account", "listing_id", F.col("observed_at").alias("at"), F.explode(F.array_compact(F.array(price, status))).alias("x"))
    return each.select("account", "listing_id", "at", "x.*")

"""Joins, windows and aggregates of the market pages: comparables, medians, trends, statuses, rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mizan.session import stored


def median(column: str | Column) -> Column:
    return F.percentile(column, 0.5)


def quantiles(column: str, prefix: str, points: dict[str, float]) -> list[Column]:
    """Exact, interpolated quantiles."""
    return [F.round(F.percentile(column, q), 4).alias(f"{prefix}_{name}") for name, q in points.items()]


def same(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """a with b's columns, joined on keys of which nulls are equal; no keys: b is one row."""
    if not keys:
        return a.crossJoin(F.broadcast(b))
    other = b.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[c for c in b.columns if c not in keys])
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return a.join(other, on).drop(*[f"__k{i}" for i in range(len(keys))])


def exact_medians(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """(keys, name): exact, interpolated medians of groups of any size; no keys: one row, null without values.

    A sketch of each group gives two marks close about its median. Values below, between and above them are counted, and
    of the part in which the two middle places lie, different values are put in order with their counts. A sketch that is
    far off makes that part larger, not the result wrong. rows are read four times: give written ones."""
    some = rows.select(*keys, F.col(value).alias("__v")).filter("__v is not null")
    marks = some.groupBy(*keys).agg(F.percentile_approx("__v", [0.499, 0.501], 10_000).alias("__m"))
    part = F.when(F.col("__v") < F.col("__m")[0], 0).when(F.col("__v") <= F.col("__m")[1], 1).otherwise(2)
    placed = same(some, marks, keys).withColumn("__part", part).drop("__m")
    sizes = placed.groupBy(*keys).agg(F.count("*").alias("__n"), F.count_if(F.col("__part") == 0).alias("__n0"), F.count_if(F.col("__part") == 1).alias("__n1"))
    sizes = sizes.withColumns({"__low": F.floor((F.col("__n") - 1) / 2), "__high": F.floor(F.col("__n") / 2)})
    holds = lambda place: F.when(F.col(place) < F.col("__n0"), 0).when(F.col(place) < F.col("__n0") + F.col("__n1"), 1).otherwise(2)
    sizes = sizes.withColumns({"__from": holds("__low"), "__to": holds("__high")})
    ahead = F.when(F.col("__from") == 0, 0).when(F.col("__from") == 1, F.col("__n0")).otherwise(F.col("__n0") + F.col("__n1"))
    sizes = sizes.select(*keys, "__low", "__high", "__from", "__to", ahead.alias("__ahead"))
    middle = same(placed, sizes, keys).filter(F.col("__part").between(F.col("__from"), F.col("__to")))
    by = middle.groupBy(*keys, "__v").agg(F.count("*").alias("__c"), *[F.first(c).alias(c) for c in ("__low", "__high", "__ahead")])
    order = Window.partitionBy(*keys).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    by = by.withColumn("__end", F.col("__ahead") + F.sum("__c").over(order))
    at = lambda place: F.max(F.when((F.col(place) < F.col("__end")) & (F.col(place) >= F.col("__end") - F.col("__c")), F.col("__v")))
    found = by.groupBy(*keys).agg(at("__low").cast("double").alias("__x"), at("__high").cast("double").alias("__y"))
    return found.select(*keys, F.when(F.col("__x") == F.col("__y"), F.col("__x")).otherwise(0.5 * F.col("__x") + 0.5 * F.col("__y")).alias(name))


def near_rows(rows: DataFrame, subjects: DataFrame, top: int = 10) -> DataFrame:
    """(listing_id, position, comparable_id, distance): each subject's nearest rows of its model by years and by 50,000
    km, itself left out. An equi-join on the model; the ranking keeps `top` a subject, and Spark cuts each task's groups
    before the shuffle (a rank filter over a window)."""
    a = subjects.select("listing_id", "model_id", F.col("model_year").alias("y"), F.col("mileage_km").alias("k"))
    b = rows.select(F.col("listing_id").alias("comparable_id"), "model_id", "model_year", "mileage_km", "asking_price")
    b = b.filter("model_year is not null and mileage_km is not null and asking_price is not null")
    both = a.filter("y is not null and k is not null").join(b, "model_id").filter("comparable_id <> listing_id")
    distance = F.abs(F.col("model_year") - F.col("y")) + F.abs(F.col("mileage_km") - F.col("k")) / 50_000
    place = F.row_number().over(Window.partitionBy("listing_id").orderBy("distance", "comparable_id"))
    ranked = both.withColumn("distance", F.round(distance, 6)).withColumn("position", place).filter(F.col("position") <= top)
    return ranked.select("listing_id", "position", "comparable_id", "distance", "asking_price")


def near_year_counts(rows: DataFrame, span: int = 2) -> DataFrame:
    """(model_id, model_year, n, near): how many rows of the model lie within `span` years. Counted by model and year
    first, so the range frame runs over years, not rows."""
    by = rows.filter("model_year is not null").groupBy("model_id", "model_year").agg(F.count("*").alias("n"))
    frame = Window.partitionBy("model_id").orderBy("model_year").rangeBetween(-span, span)
    return by.withColumn("near", F.sum("n").over(frame))


def usual_prices(rows: DataFrame, span: int = 2, least: int = 3) -> DataFrame:
    """(model_id, model_year, near_median): the median asking price of the model's rows within `span` years of each year,
    or of the whole model if fewer than `least` are so near; also for years next to those that rows have.

    Each row is offered to the years it is near to, so work is rows times the span, never rows times rows or years."""
    priced = rows.filter("model_year is not null and asking_price is not null")
    offered = priced.select("model_id", F.explode(F.sequence(F.col("model_year") - span, F.col("model_year") + span)).alias("model_year"), "asking_price")
    close = offered.groupBy("model_id", "model_year").agg(F.count("*").alias("n"), F.percentile("asking_price", 0.5).alias("close"))
    whole = priced.groupBy("model_id").agg(F.percentile("asking_price", 0.5).alias("whole"))
    return close.join(whole, "model_id").select("model_id", "model_year", F.when(F.col("n") >= least, F.col("close")).otherwise(F.col("whole")).alias("near_median"))


def price_outliers(rows: DataFrame, span: int = 2, least: int = 3, factor: float = 3.0, usual: DataFrame | None = None) -> DataFrame:
    """rows and near_median, is_outlier: an asking price outside a factor of its model's and year's usual one; usual:
    usual_prices() that have been written, if they are."""
    priced = rows.filter("model_year is not null and asking_price is not null")
    both = priced.join(usual_prices(rows, span, least) if usual is None else usual, ["model_id", "model_year"])
    off = (F.col("asking_price") > F.col("near_median") * factor) | (F.col("asking_price") * factor < F.col("near_median"))
    return both.withColumn("is_outlier", off)


def first_of_reposts(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first by the order. Among rows of one key only a bounded state is kept: a window with
    row_number = 1, which Spark turns into a group limit."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def latest(rows: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """(key, value) of each key's latest row by (at, value): one aggregate, no sort."""
    return rows.groupBy(key).agg(F.max_by(value, F.struct(at, value)).alias(value))


def agreed(models: DataFrame, trims: DataFrame) -> DataFrame:
    """Values of models(model_key, volume) that no trim(model_key, volume) contradicts."""
    against = trims.join(models.withColumnRenamed("volume", "said"), "model_key").filter("volume <> said").select("model_key")
    return models.filter("volume is not null").join(against.distinct(), "model_key", "left_anti")


def longest_prefix(keys: DataFrame, names: DataFrame) -> DataFrame:
    """(key, name): the longest of names(name) that is the key's first dotted parts. Every key offers all its prefixes, so
    the match is an equi-join."""
    parts = F.split("key", "\\.")
    offered = keys.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))).alias("name"))
    best = offered.join(names.select("name").distinct(), "name").groupBy("key").agg(F.max_by("name", F.length("name")).alias("name"))
    return keys.select("key").join(best, "key", "left")


def under_scopes(rows: DataFrame, scopes: DataFrame, column: str, separator: str = ".") -> DataFrame:
    """rows joined with every scope(scope) that is their key or lies above it; a null scope holds all rows. Keys offer
    their prefixes, so this is an equi-join instead of a comparison of every row with every scope."""
    parts = F.split(column, "\\" + separator)
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), separator))
    each = rows.withColumn("__scope", F.explode(F.concat(F.array(F.lit("")), prefixes)))
    return each.join(scopes.withColumn("__scope", F.coalesce("scope", F.lit(""))), "__scope").drop("__scope")


def model_overview(rows: DataFrame) -> DataFrame:
    """One row for each model: counts, ratings, price quantiles and shares."""
    ratings = [F.count_if(F.col("rating") == r).alias(f"n_{r}") for r in ("great", "good", "fair", "high", "overpriced")]
    return rows.groupBy("model_key").agg(
        F.count("*").alias("n"),
        F.count("asking_price").alias("n_priced"),
        F.min("asking_price").alias("least_price"),
        F.max("asking_price").alias("most_price"),
        *quantiles("asking_price", "price", {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}),
        F.round(median("mileage_km"), 4).alias("median_km"),
        *ratings,
        F.count("accident").alias("accident_known"),
        F.count_if(F.col("accident") == "had_accident").alias("accident_yes"),
    )


def model_years(rows: DataFrame) -> DataFrame:
    return rows.filter("model_year is not null").groupBy("model_key", "model_year").agg(
        F.count("*").alias("n"), F.round(median("asking_price"), 4).alias("median_price"), F.round(median("mileage_km"), 4).alias("median_km")
    )


def modal_year(years: DataFrame) -> DataFrame:
    """(model_key, model_year, n): the year with most rows; the newer of equals."""
    best = years.groupBy("model_key").agg(F.max(F.struct("n", "model_year")).alias("b"))
    return best.select("model_key", F.col("b.model_year").alias("model_year"), F.col("b.n").alias("n"))


def daily_trend(rows: DataFrame) -> DataFrame:
    """(make_key, day, n, median, quartiles) of what was listed on each day."""
    return rows.filter("asking_price is not null").groupBy("make_key", F.to_date("listed_at").alias("day")).agg(
        F.count("*").alias("n"), *quantiles("asking_price", "price", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    )


def week_start(day: Column) -> Column:
    """The Saturday on or before a day."""
    return F.date_sub(day, F.dayofweek(day) % 7)


def weekly_points(trend: DataFrame, least: int = 2) -> DataFrame:
    """Of each make and Saturday week, the last day with enough rows."""
    some = trend.filter(F.col("n") >= least).withColumn("week", week_start(F.col("day")))
    best = some.groupBy("make_key", "week").agg(F.max_by(F.struct("day", "n", "price_p50"), "day").alias("x"))
    return best.select("make_key", "week", "x.day", "x.n", "x.price_p50")


def trend_change(points: DataFrame, back: int, slack: int = 4) -> DataFrame:
    """(make_key, day, before_day, change): the percent change from the point `back` days earlier, or the nearest within
    `slack` days; the later of two equally near. The join is on days that a point offers, not on a range."""
    now = points.select("make_key", F.col("day").alias("now_day"), F.col("price_p50").alias("now_price"))
    offers = now.withColumn("day", F.explode(F.sequence(F.date_sub("now_day", back + slack), F.date_sub("now_day", back - slack))))
    both = offers.join(points.select("make_key", "day", "price_p50"), ["make_key", "day"])
    off = F.abs(F.datediff("now_day", "day") - back)
    best = both.groupBy("make_key", "now_day", "now_price").agg(F.min_by(F.struct("day", "price_p50"), F.struct(off, -F.datediff("day", F.lit("1970-01-01")))).alias("b"))
    change = F.round((F.col("now_price") / F.col("b.price_p50") - 1) * 100, 4)
    return best.select("make_key", F.col("now_day").alias("day"), F.col("b.day").alias("before_day"), change.alias("change"))


def top_per(rows: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key, with their position."""
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("position") <= k)


def mode_of(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, n): each key's most frequent value, the first by name among equals."""
    n = rows.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    return first_of_reposts(n, [key], [F.desc("n"), F.asc(value)])


def source_status(rows: DataFrame, now: Column) -> DataFrame:
    """Counts and medians by source and, in the same pass (a rollup), of all."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_seen_at").cast("timestamp"))) / 60e6
    seen = rows.withColumn("__age", F.greatest(age, F.lit(0.0)))
    return seen.rollup("source_id").agg(
        F.grouping("source_id").cast("int").alias("is_total"),
        F.count("*").alias("n"),
        F.count_if(F.col("__age") <= 48 * 60).alias("fresh"),
        F.countDistinct("model_key").alias("models"),
        F.round(median("__age"), 0).cast("long").alias("median_minutes"),
        F.round(F.avg("asking_price"), 2).alias("mean_price"),
    )


def pivot_facts(facts: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row for each key, a column for each field: the largest of its values."""
    return facts.groupBy(key).pivot("field", fields).agg(F.max("value"))


def aliases(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, words): a key's different values in order, joined by a space."""
    return rows.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(value)), " ").alias("words"))


def numbered(rows: DataFrame, key: str, *more: str) -> DataFrame:
    """(key, more, n): places from 1 in ascending key order, equal keys in any order among themselves.

    Rows are range-partitioned and sorted, and written with their range and place in it; a row's number is its place plus
    the rows of the ranges before. Rows move once, and no task numbers more than one range."""
    low = 33  # bits of monotonically_increasing_id() that hold the place in a partition
    placed = stored(rows.select(key, *more).repartitionByRange(key).sortWithinPartitions(key).withColumn("__at", F.monotonically_increasing_id()), "places")
    placed = placed.withColumn("__p", F.shiftright("__at", low))
    sizes = placed.groupBy("__p").agg(F.count("*").alias("__n"))
    ahead = sizes.select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    n = F.col("__at").bitwiseAND((1 << low) - 1) + 1 + F.col("__before")
    return placed.join(F.broadcast(ahead), "__p").select(key, *more, n.alias("n"))  # one row a range


def chunk_bounds(rows: DataFrame, key: str, every: int) -> DataFrame:
    """The first key of every lot of `every` rows in ascending order."""
    return numbered(rows, key).filter(F.col("n") % every == 1)

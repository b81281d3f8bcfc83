"""The columns of a search document, what a listing's page says about it, and notices about marked listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mizan.operators.market import exact_medians, same
from mizan.session import stored

#: Conditions that count as painted or not, sizes that are shown, and targets.
PAINTED_TEXT = ("spots", "partial", "around", "full")
PAINTED_BODY = ("partly_repainted", "repainted_around", "fully_repainted", "accident_damaged", "salvage")
CLEAN_BODY = ("intact", "minor_scratches", "paintless_dent_repair")
CRASHED_BODY = ("accident_damaged", "salvage")
OFF_MARKET = ("sold", "expired", "gone")
LEAST_ADJUSTMENT, GAUGE_HALF, VISIT_MINUTES, FRESH_HOURS = 0.5, 20, 5, 6
LCG_FACTOR, LCG_STEP, LCG_BITS = 1664525, 1013904223, 32


def inherited_specs(rows: DataFrame, specs: DataFrame, countries: DataFrame) -> DataFrame:
    """rows(listing_id, make_id, model_id, trim_id, engine_cc) with engine volume and where it is from, origin and country.

    specs(model_id, trim_id, engine_cc, origin), a null trim for the model, one row each; countries(make_id, model_id,
    country), a null model for the make. A volume is the listing's, else its trim's, else its model's if no trim has another."""
    trims = specs.filter("trim_id is not null").select("model_id", "trim_id", F.col("engine_cc").alias("__t"), F.col("origin").alias("__to"))
    whole = specs.filter("trim_id is null").select("model_id", F.col("engine_cc").alias("__m"), F.col("origin").alias("__mo"))
    told = trims.groupBy("model_id").agg(F.min("__t").alias("__low"), F.max("__t").alias("__high"))
    other = F.coalesce((F.col("__low") != F.col("__m")) | (F.col("__high") != F.col("__m")), F.lit(False))
    model = whole.join(told, "model_id", "left").withColumn("__m", F.when(~other, F.col("__m"))).drop("__low", "__high")
    of_model = countries.filter("model_id is not null").select("make_id", "model_id", F.col("country").alias("__mc"))
    of_make = countries.filter("model_id is null").select("make_id", F.col("country").alias("__kc"))
    all_ = rows.join(trims, ["model_id", "trim_id"], "left").join(model, "model_id", "left").join(of_model, ["make_id", "model_id"], "left").join(of_make, "make_id", "left")
    first = lambda *named: F.coalesce(*[F.when(F.col(c).isNotNull(), n) for c, n in named])
    return all_.select(
        "listing_id",
        F.coalesce("engine_cc", "__t", "__m").alias("engine_cc"),
        first(("engine_cc", "listing"), ("__t", "trim"), ("__m", "model")).alias("engine_source"),
        F.coalesce("__to", "__mo").alias("origin"),
        F.coalesce("__mc", "__kc").alias("country"),
        first(("__mc", "model"), ("__kc", "make")).alias("country_source"),
    )


def chassis_condition(front: Column, rear: Column, stated: Column) -> Column:
    """damaged where any side or the text says so, then repainted, then intact: both sides, or the text where no side is told."""
    any_is = lambda x: (front == x) | (rear == x)
    intact = (front == "intact") & (rear == "intact") | front.isNull() & rear.isNull() & (stated == "intact")
    return F.when(any_is("damaged") | (stated == "damaged"), "damaged").when(any_is("repainted"), "repainted").when(intact, "intact")


def paint_free(paint: Column, body: Column) -> Column:
    return F.when(paint.isin(*PAINTED_TEXT) | body.isin(*PAINTED_BODY), False).when((paint == "none") | body.isin(*CLEAN_BODY), True)


def accident(stated: Column, body: Column) -> Column:
    return F.when((stated == "had_accident") | body.isin(*CRASHED_BODY), "had_accident").when(stated == "none", "none")


def offers(accepts: Column, stated: Column, *more: Column) -> Column:
    """True if any source says yes, else false if any says no, else null."""
    yes = accepts | (stated == "yes")
    for x in more:
        yes = yes | x
    return F.when(yes, True).when(~accepts | (stated == "no"), False)


def km_per_year(km: Column, year: Column, now: int) -> Column:
    """Half a year at least; whole kilometres, halves away from zero."""
    return F.round(km / F.greatest(F.lit(now) - year, F.lit(0.5))).cast("int")


def search_text(*parts: Column) -> Column:
    return F.concat_ws(" ", *parts)


def named(key: Column, *names: Column) -> Column:
    """struct(key, name): the first name there is; null without a key."""
    return F.when(key.isNotNull(), F.struct(key.alias("key"), F.coalesce(*names).alias("name")))


def seen_baseline(viewed: Column, previous: Column, now: Column) -> Column:
    """What was there before the visit that goes on: a look under five minutes old belongs to it."""
    return F.when(viewed > now - F.make_dt_interval(mins=F.lit(VISIT_MINUTES)), previous).otherwise(viewed)


def adjustment(coefficient: Column, value: Column) -> Column:
    """Percent by which a term of the price model moves a value; null where it is too small to show."""
    size = (F.exp(coefficient * value) - 1) * 100
    return F.when(F.abs(size) >= LEAST_ADJUSTMENT, size)


def gauge(gap: Column) -> Column:
    """struct(share, beyond): where a gap in percent sits on the bar, 0 to 1, and whether it lies beyond the bar."""
    held = F.least(F.greatest(gap, F.lit(-GAUGE_HALF)), F.lit(GAUGE_HALF))
    return F.struct(((held + GAUGE_HALF) / (2.0 * GAUGE_HALF)).alias("share"), (F.abs(gap) > GAUGE_HALF).alias("beyond"))


def nice_step(raw: Column) -> Column:
    """1, 2, 2.5, 5 or 10 times a power of ten, the least that is not below raw; null where raw is not positive."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    unit = raw / power
    return F.when(raw > 0, power * F.when(unit <= 1, 1.0).when(unit <= 2, 2.0).when(unit <= 2.5, 2.5).when(unit <= 5, 5.0).otherwise(10.0))


def lcg_share(index: Column, seed: int) -> Column:
    """The share in [0, 1) that a linear congruential generator gives at place `index`, from 1 and below 2**32: any place at
    once, since 2, 4, 8, ... steps of the generator together are steps of the same form."""
    size, steps, a, c = 1 << LCG_BITS, [], LCG_FACTOR, LCG_STEP
    for _ in range(LCG_BITS):
        steps.append(F.struct(F.lit(a >> 16).cast("long").alias("high"), F.lit(a & 0xFFFF).cast("long").alias("low"), F.lit(c).cast("long").alias("add")))
        a, c = a * a % size, (a * c + c) % size
    bits = F.filter(F.array(*steps), lambda _, i: F.getbit(index.cast("long"), i) == 1)
    moved = lambda state, s: (state * s["low"] + (state * s["high"] % (1 << 16)) * (1 << 16) + s["add"]) % size
    return F.aggregate(bits, F.lit(seed).cast("long"), moved) / float(size)


def with_photos(rows: DataFrame, photos: DataFrame) -> DataFrame:
    """rows(listing_id, ...) with photo_count and cover: the url of the first position; photos(listing_id, position, url)."""
    by_listing = photos.groupBy("listing_id").agg(F.count("*").alias("photo_count"), F.min_by("url", F.struct("position", "url")).alias("cover"))
    return rows.join(by_listing, "listing_id", "left").withColumn("photo_count", F.coalesce("photo_count", F.lit(0)))


def merged_counts(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Two keyed lists of counts as one: keys of either, 0 where a side lacks one."""
    counts = [c for c in [*left.columns, *right.columns] if c not in keys]
    return left.join(right, keys, "full").select(*keys, *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])


def last_of_day(runs: DataFrame, day: str, run: str) -> DataFrame:
    """The rows of each day's last run."""
    return runs.join(runs.groupBy(day).agg(F.max(run).alias(run)), [day, run], "left_semi")


def after_in_inbox(notices: DataFrame, owner, last) -> DataFrame:
    """The owner's notices before the one called `last`, newest first; none if that one is not the owner's."""
    own = notices.filter(F.col("account_id") == owner)
    at = own.filter(F.col("id") == last).agg(F.max(F.struct("created_at", "id")).alias("__at"))  # one row
    return own.crossJoin(F.broadcast(at)).filter(F.struct("created_at", "id") < F.col("__at")).drop("__at").orderBy(F.desc("created_at"), F.desc("id"))


def quota(candidates: DataFrame, shares: dict[str, int], total: int) -> DataFrame:
    """The newest candidates(priority, id, first_seen) of each priority, as many as its share of the total, floored."""
    weight = sum(shares.values())
    most = F.create_map(*[F.lit(x) for k, v in shares.items() for x in (k, total * v // weight)])
    place = F.row_number().over(Window.partitionBy("priority").orderBy(F.desc("first_seen"), F.desc("id")))
    return candidates.filter(F.col("priority").isin(*shares)).withColumn("place", place).filter(F.col("place") <= F.try_element_at(most, F.col("priority")))


def spread(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, centre, scale): median and scaled median distance from it."""
    centre = rows.groupBy(*keys).agg(F.percentile(value, 0.5).alias("centre"))
    off = F.abs(F.col(value) - F.col("centre"))
    return rows.join(centre, keys).groupBy(*keys).agg(F.count(value).alias("n"), F.first("centre").alias("centre"), (F.percentile(off, 0.5) * 1.4826).alias("scale"))


def accuracy(rows: DataFrame, key: str) -> DataFrame:
    """rows(key, predicted, price): tested, median error in percent and the share within 10 %, by key and, key null, of all."""
    error = F.abs(F.col("predicted") - F.col("price")) * 100 / F.col("price")
    scored = stored(rows.select(key, error.alias("e")).filter("e is not null"))
    tallies = [F.count("*").alias("tested"), F.round(F.count_if(F.col("e") <= 10) * 100 / F.count("*"), 2).alias("within_10")]
    shown = (key, "tested", F.round("__median", 2).alias("mdape"), "within_10")
    by = same(scored.groupBy(key).agg(*tallies), exact_medians(scored, [key], "e", "__median"), [key]).select(*shown)
    total = same(scored.groupBy(F.lit(None).cast(scored.schema[key].dataType).alias(key)).agg(*tallies), exact_medians(scored, [], "e", "__median"), []).select(*shown)
    return by.unionByName(total)


def class_scores(rows: DataFrame, label: str, answer: str) -> DataFrame:
    """(value, labelled, answered, precision, recall) of each value that is a label or an answer."""
    pair = F.explode(F.array_distinct(F.array(label, answer)))
    seen = rows.select(pair.alias("value"), label, answer).filter("value is not null")
    is_ = lambda c: F.coalesce(F.col(c) == F.col("value"), F.lit(False))
    out = seen.groupBy("value").agg(F.count_if(is_(label)).alias("labelled"), F.count_if(is_(answer)).alias("answered"), F.count_if(is_(label) & is_(answer)).alias("both"))
    return out.select("value", "labelled", "answered", (F.col("both") / F.nullif("answered", F.lit(0))).alias("precision"), (F.col("both") / F.nullif("labelled", F.lit(0))).alias("recall"))


def contains_any(text: str, *columns: str) -> Column:
    """Some column contains the text, whatever the case; % and _ mean themselves."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.contains(F.lower(c), F.lit(text.lower())), F.lit(False))
    return out


def exactly_one(*columns: str) -> Column:
    """Just one of the columns has a value."""
    return sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0)) == 1


def freshness_state(status: Column, checked: Column, now: Column) -> Column:
    """off_market, stale (never read, or more than six hours ago) or fresh."""
    old = F.coalesce(now - checked > F.make_dt_interval(hours=F.lit(FRESH_HOURS)), F.lit(True))
    return F.when(~status.eqNullSafe("active"), "off_market").when(old, "stale").otherwise("fresh")


def target_status(measured: Column, target) -> Column:
    return F.when(measured.isNull(), "unmeasured").when(measured <= target, "met").otherwise("missed")


def source_state(crawl: Column, last_read: Column, now: Column, minutes: int = 60) -> Column:
    late = F.coalesce(now - last_read > F.make_dt_interval(mins=F.lit(minutes)), F.lit(True))
    return F.when(~crawl.eqNullSafe("enabled"), "not_updating").when(late, "delayed").otherwise("live")


def status_notices(marks: DataFrame, listings: DataFrame) -> DataFrame:
    """marks(account_id, listing_id, seen_status, status_version) against listings(listing_id, status): account_id,
    listing_id, seen_status and status_version as they become, and kind: off_market when an active one was sold, expired or
    went, relisted when such a one is active again; null where the status alone moves. Each notice counts the version up."""
    leaves = (F.col("seen_status") == "active") & F.col("status").isin(*OFF_MARKET)
    returns = F.col("seen_status").isin(*OFF_MARKET) & (F.col("status") == "active")
    both = marks.join(listings, "listing_id").filter("seen_status <> status")
    told = F.when(leaves, "off_market").when(returns, "relisted")
    return both.select("account_id", "listing_id", F.col("status").alias("seen_status"), (F.col("status_version") + told.isNotNull().cast("int")).alias("status_version"), told.alias("kind"))


def drop_notices(marks: DataFrame, changes: DataFrame) -> DataFrame:
    """marks(account_id, listing_id, seen_id) against changes(listing_id, id, price_type, asking_price, last_asking_price):
    the drops that a mark has not seen. seen_through, on each, is the last change of any kind that the mark has now seen."""
    new = marks.join(changes, "listing_id").filter("id > seen_id")
    through = F.max("id").over(Window.partitionBy("account_id", "listing_id"))
    return new.withColumn("seen_through", through).filter("price_type = 'asking' and asking_price < last_asking_price").select("account_id", "listing_id", "id", "last_asking_price", "asking_price", "seen_through")


def risk_flags(price_type: str, instalments: str, km: str, body: str, front: str, rear: str, no_rating: str, facts: str) -> Column:
    """The flags of a listing's page, in their fixed order. facts: a column of array<struct(field, value)> from its text."""
    c = F.col
    has = lambda f, *v: F.exists(facts, lambda x: (x["field"] == f) & x["value"].isin(*v))
    is_ = lambda column, *v: F.coalesce(c(column).isin(*v), F.lit(False))
    takes = F.coalesce(c(instalments), F.lit(False))
    price = F.when(is_(price_type, "installment") | has("price_meaning", "down_payment"), "down_payment").when(has("price_meaning", "starting_from"), "starting_from").when(takes | has("installment", "yes"), "installments")
    flags = [
        price,
        F.when(is_(no_rating, "installment_price") & ~is_(price_type, "installment") & takes, "installment_guard"),
        F.when(c(km).isNull(), "mileage_unread"),
        F.when(is_(body, *CLEAN_BODY) & has("paint", *PAINTED_TEXT), "paint_conflict"),
        F.when((is_(front, "intact") | is_(rear, "intact")) & has("chassis", "damaged"), "chassis_conflict"),
        F.when(has("accident", "had_accident") & is_(body, "intact"), "accident_conflict"),
        F.when(has("plate", "free_zone"), "free_zone"),
        F.when(has("ride_hailing", "used"), "ride_hailing"),
        F.when(is_(no_rating, "price_outlier"), "price_outlier"),
    ]
    return F.filter(F.array(*flags), lambda x: x.isNotNull())

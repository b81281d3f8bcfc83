"""Change capture and its neighbours: price events, statuses, freshness, alerts, throttles, budgets, merges."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

TEHRAN = "Asia/Tehran"


def price_changes(observed: DataFrame) -> DataFrame:
    """observed(listing_id, observed_at, price_type, asking_price): those that differ from the one before, with the
    previous type and price and the last asking price before. Equal instants: by type and price. One sort by listing."""
    w = Window.partitionBy("listing_id").orderBy("observed_at", "price_type", "asking_price")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    seen = observed.withColumns(
        {
            "previous_type": F.lag("price_type").over(w),
            "previous_price": F.lag("asking_price").over(w),
            "last_asking_price": F.last("asking_price", ignorenulls=True).over(before),
        }
    )
    same = F.col("price_type").eqNullSafe(F.col("previous_type")) & F.col("asking_price").eqNullSafe(F.col("previous_price"))
    return seen.filter(~same)


def price_drops(changes: DataFrame) -> DataFrame:
    """Asking prices under the last asking price, whatever stood between."""
    return changes.filter((F.col("price_type") == "asking") & (F.col("asking_price") < F.col("last_asking_price")))


def price_history(changes: DataFrame) -> DataFrame:
    """(listing_id, changes, first_price, last_price, total_change, days): whole days between the first and last event."""
    ordered = F.struct("observed_at", "asking_price")
    priced = changes.filter("asking_price is not null")
    out = priced.groupBy("listing_id").agg(
        F.count("*").alias("changes"),
        F.min_by("asking_price", ordered).alias("first_price"),
        F.max_by("asking_price", ordered).alias("last_price"),
        F.datediff(F.to_date(F.max("observed_at")), F.to_date(F.min("observed_at"))).alias("days"),
    )
    change = F.round((F.col("last_price") - F.col("first_price")) * 100 / F.col("first_price"), 4)
    return out.withColumn("total_change", change)


def sightings(rows: DataFrame, key: str, at: str) -> DataFrame:
    """(key, first_seen, last_seen, n)."""
    return rows.groupBy(key).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count("*").alias("n"))


def refreshed(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """stored(key, last_seen, status) after a sweep seen(key, at): last_seen moves when it is over a day old; expired and
    gone listings that are seen live again; what is new is added."""
    latest = seen.groupBy("key").agg(F.max("at").alias("at"))
    both = stored.join(latest, "key", "full_outer")
    old = F.col("last_seen").isNull() | (F.col("at") > F.col("last_seen") + F.expr("INTERVAL 1 DAY"))
    status = F.when(F.col("at").isNotNull(), "active").otherwise(F.col("status"))
    return both.select("key", F.when(old & F.col("at").isNotNull(), F.col("at")).otherwise(F.col("last_seen")).alias("last_seen"), status.alias("status"))


def gone(stored: DataFrame, sweep: DataFrame) -> DataFrame:
    """Active listings that a complete sweep lacks."""
    return stored.filter("status = 'active'").join(sweep.select("key").distinct(), "key", "left_anti")


def expired(rows: DataFrame, now: Column) -> DataFrame:
    """Past their end, and not seen since it."""
    return rows.filter((F.col("expires_at") < now) & (F.col("last_seen_at") <= F.col("expires_at")))


def merged_sweep(rows: DataFrame) -> DataFrame:
    """One row for each key(key, place, model_key): the last place's, with the finest model key of all its rows."""
    finest = F.max_by("model_key", F.struct(F.size(F.split("model_key", "\\.")), "place"))
    return rows.groupBy("key").agg(F.max("place").alias("place"), finest.alias("model_key"))


def difference(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """(key, action): what makes stored into fresh: insert, update, delete; rows that are equal are left out. Both share
    their columns; one full outer join of key and a hash of all values and of which are null."""
    values = [c for c in fresh.columns if c != key]
    h = lambda t, n: t.select(key, F.xxhash64(*[x for c in values for x in (F.col(c).isNull(), F.col(c))]).alias(n))
    both = h(stored, "a").join(h(fresh, "b"), key, "full_outer")
    action = F.when(F.col("a").isNull(), "insert").when(F.col("b").isNull(), "delete").when(F.col("a") != F.col("b"), "update")
    return both.select(key, action.alias("action")).filter("action is not null")


def merged(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """stored with fresh's rows put in or over it."""
    return stored.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def inserted_if_absent(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of fresh whose key is new, one for each key."""
    return fresh.dropDuplicates(keys).join(stored.select(*keys).distinct(), keys, "left_anti")


def bounded_counts(stored: DataFrame, asked: DataFrame, keys: list[str], most: int = 1_000_000) -> DataFrame:
    """Counters(keys, n) plus one for each row asked, up to a most."""
    new = asked.groupBy(*keys).agg(F.count("*").alias("n"))
    return stored.unionByName(new).groupBy(*keys).agg(F.least(F.sum("n"), F.lit(most)).cast("long").alias("n"))


def evicted(rows: DataFrame, at: str, most: int, keep: int) -> DataFrame:
    """rows(key, at, n) once they reach `most`: those asked once go, oldest first, until `keep` are left.

    How many must go is known from a count; the oldest of them are a top-k."""
    n = rows.count()
    if n < most:
        return rows
    old = rows.filter("n = 1").orderBy(at, "key").limit(n - keep).select("key")
    return rows.join(old, "key", "left_anti")


def retained(runs: DataFrame, today: Column, days: int) -> DataFrame:
    """The last run of each (day, method) not older than so many days."""
    last = F.row_number().over(Window.partitionBy("as_of_date", "method").orderBy(F.desc("run_id")))
    return runs.withColumn("__n", last).filter((F.col("__n") == 1) & (F.col("as_of_date") >= F.date_sub(today, days))).drop("__n")


def tehran_day(at: Column) -> Column:
    """The civil day in Tehran of a UTC instant."""
    return F.to_date(F.from_utc_timestamp(at.cast("timestamp"), TEHRAN))


def freshness(rows: DataFrame, at: str, age: str, start: Column, end: Column) -> DataFrame:
    """One row for (start, end]: count, median and 90th percentile of ages, floored at 0, in whole minutes."""
    some = rows.filter((F.col(at) > start) & (F.col(at) <= end))
    minutes = F.greatest(F.col(age), F.lit(0.0))
    return some.agg(
        F.count("*").alias("n"),
        F.bround(F.percentile(minutes, 0.5)).cast("long").alias("p50"),
        F.bround(F.percentile(minutes, 0.9)).cast("long").alias("p90"),
    )


def sliding(rows: DataFrame, at: str, value: str, width: str = "24 hours", step: str = "6 hours") -> DataFrame:
    """(ends, n, p50): windows (end - width, end] that slide by step. Spark's windows hold their start and not their end,
    so instants are read a microsecond earlier."""
    early = rows.withColumn("__at", F.col(at).cast("timestamp_ntz") - F.expr("INTERVAL 1 MICROSECOND"))
    out = early.groupBy(F.window("__at", width, step).alias("w")).agg(F.count("*").alias("n"), F.round(F.percentile(value, 0.5), 4).alias("p50"))
    return out.select(F.col("w.end").alias("ends"), "n", "p50")


def sessions(rows: DataFrame, key: str, at: str, gap: str = "30 minutes") -> DataFrame:
    """(key, starts, n): runs of events less than a gap apart."""
    out = rows.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("starts"), "n")


def flows(rows: DataFrame, at: str, now: Column, kinds: str) -> DataFrame:
    """(kind, hour, day, week): counts of the last hour, 24 hours and 7 days, in one pass."""
    since = lambda d: F.count_if((F.col(at) > now - F.expr(d)) & (F.col(at) <= now))
    return rows.groupBy(F.col(kinds).alias("kind")).agg(since("INTERVAL 1 HOUR").alias("hour"), since("INTERVAL 1 DAY").alias("day"), since("INTERVAL 7 DAY").alias("week"))


def silent(beats: DataFrame, key: str, at: str, now: Column, seconds: int) -> DataFrame:
    """(key, last, alive)."""
    last = beats.groupBy(key).agg(F.max(at).alias("last"))
    return last.withColumn("alive", F.col("last") >= now - F.make_interval(secs=F.lit(seconds)))


def daily_spend(rows: DataFrame, at: str, keys: list[str], amount: str) -> DataFrame:
    return rows.groupBy(*keys, tehran_day(F.col(at)).alias("day")).agg(F.count("*").alias("n"), F.round(F.sum(amount), 4).alias("spent"))


def within_budget(rows: DataFrame, day: str, order: str, budget: int, reserves: dict[str, float], tier: str) -> DataFrame:
    """rows and allowed: whether a request, in order, still leaves its tier's reserve (rounded up) of the day's budget. What
    is refused spends nothing, so a tier that is closed does not shorten the others' day.

    A day's requests are read in order by one task, which carries what is spent; it holds a batch at a time."""
    some = rows.withColumns({"__day": F.col(day).cast("string"), "__tier": F.col(tier).cast("string")})
    schema = StructType([*rows.schema.fields, StructField("allowed", BooleanType())])
    kept = rows.columns
    limits = {t: budget - math.ceil(budget * share) for t, share in reserves.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        today, spent = None, 0
        for batch in batches:
            allowed = []
            for d, t in zip(batch.column("__day").to_pylist(), batch.column("__tier").to_pylist(), strict=True):
                if d != today:
                    today, spent = d, 0
                allowed.append(spent + 1 <= limits.get(t, budget))
                spent += allowed[-1]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(allowed, pa.bool_())], [*kept, "allowed"])

    return some.repartition("__day").sortWithinPartitions("__day", order, *[c for c in rows.columns if c != order]).mapInArrow(run, schema)


def throttled(digests: DataFrame, key: str, at: str, minutes: int = 120, most: int = 8) -> DataFrame:
    """digests that are sent, with day and place: `minutes` or more after the last one sent, and among the first `most` of
    their Tehran day. One that is not sent, for either reason, holds back none. A null instant has no gap to keep.

    A key's digests are read in order by one task, which carries the last sent instant and the day's count; it holds a
    batch at a time, however many a key has."""
    order = digests.withColumns({"day": tehran_day(F.col(at)), "__us": F.unix_micros(F.col(at).cast("timestamp")), "__key": F.col(key).cast("string")})
    kept = [*digests.columns, "day"]
    schema = StructType([*[order.schema[c] for c in kept], StructField("place", IntegerType())])
    gap = minutes * 60_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, now, last, today, n = True, None, None, None, 0
        for batch in batches:
            rows, places = [], []
            for i, (k, us, day) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("__key", "__us", "day")], strict=True)):
                if first or k != now:
                    first, now, last, today, n = False, k, None, None, 0
                if day != today:
                    today, n = day, 0
                if n < most and (us is None or last is None or us - last >= gap):
                    last, n = us, n + 1
                    rows.append(i)
                    places.append(n)
            some = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*[some.column(c) for c in kept], pa.array(places, pa.int32())], [*kept, "place"])

    return order.repartition("__key").sortWithinPartitions("__key", "__us").mapInArrow(run, schema)


def once(notices: DataFrame) -> DataFrame:
    """One notice for each account and event key, the first by instant."""
    return notices.groupBy("account", "event_key").agg(F.min("at").alias("at"))


def unread(snapshots: DataFrame, extractions: DataFrame, version: int) -> DataFrame:
    """Current snapshots(listing_id, snapshot_id, at) that extractions(snapshot_id, version) lack at the version."""
    now = snapshots.groupBy("listing_id").agg(F.max_by("snapshot_id", F.struct("at", "snapshot_id")).alias("snapshot_id"))
    return now.join(extractions.filter(F.col("version") == version).select("snapshot_id").distinct(), "snapshot_id", "left_anti")


def matched(files: list[tuple[str, Column]], news: DataFrame, low: Column, high: Column, at: str) -> DataFrame:
    """(file, n, good, newest) of stored searches over news in (low, high]: one scan, conditional sums for all of them."""
    some = news.filter((F.col(at) > low) & (F.col(at) <= high))
    each = some.select(F.explode(F.array_compact(F.array(*[F.when(c, F.lit(f)) for f, c in files]))).alias("file"), "rating", at)
    return each.groupBy("file").agg(F.count("*").alias("n"), F.count_if(F.col("rating").isin("great", "good")).alias("good"), F.max(at).alias("newest"))


def fulfilled(requests: DataFrame, scopes: DataFrame, listings: DataFrame) -> DataFrame:
    """Requests whose scope is known and has a listing."""
    return requests.join(scopes, "scope", "left_semi").join(listings, "scope", "left_semi")

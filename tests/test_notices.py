"""Notices of marked listings: the batch form against a loop, and the stream against the batch form."""

import datetime as dt
import random

import pytest

from mizan.operators.notices import mark_notices
from mizan.streaming.notices import notice_stream

EVENTS = "listing_id long, observed_at timestamp_ntz, status string, price_type string, asking_price long"
MARKS = "account long, listing_id long, marked_at timestamp_ntz"
START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def data():
    rng = random.Random(4)
    events, at = [], START
    for i in range(400):
        at += dt.timedelta(hours=rng.choice([1, 2, 30, 900] if i % 90 == 89 else [1, 2, 9]))
        kind = rng.choice(["asking", "asking", "negotiable"])
        events.append((rng.randrange(12), at, rng.choice(["active", "active", "sold", "gone", "expired", "removed"]), kind, rng.choice([None, 100, 90, 80, 110]) if kind == "asking" else None))
    marks = [(a, i, START + dt.timedelta(hours=rng.randrange(300))) for a in range(3) for i in range(12) if (a + i) % 4]
    return events, marks


def loop(events, marks):
    out = []
    for account, listing, marked in marks:
        last = None
        for i, at, status, kind, price in sorted(set(events), key=lambda e: (e[1], e[2], e[3], e[4] is not None, e[4] or 0)):
            if i != listing:
                continue
            if last is None or at - last[0] > dt.timedelta(days=30):
                last = (at, None, None, 0)
            asked = price if kind == "asking" else None
            _, before, known, version = last
            if at > marked:
                if asked is not None and known is not None and asked < known:
                    out.append((account, listing, at, "price_drop", None, known, asked))
                off = ("sold", "gone", "expired")
                if before == "active" and status in off or before in off and status == "active":
                    version += 1
                    out.append((account, listing, at, "off_market" if before == "active" else "relisted", version, None, asked if status == "active" else None))
            last = (at, status, known if asked is None else asked, version)
    return sorted(out, key=str)


def test_batch_equals_the_loop(spark, data):
    events, marks = data
    got = mark_notices(spark.createDataFrame([*events, *events[:50], (None, START, "sold", "asking", 5)], EVENTS), spark.createDataFrame(marks, MARKS))
    want = loop(events, marks)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert {r[3] for r in want} == {"price_drop", "off_market", "relisted"} and max(r[4] or 0 for r in want) > 3


def test_stream_equals_batch(spark, data, tmp_path):
    events, marks = data
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source = f"{tmp_path}/in"
    lots = [events[:90], events[90:180], events[150:300], events[300:]]  # the third brings rows again
    for lot in lots:
        spark.createDataFrame(lot, EVENTS).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(source)
    told = notice_stream(stream, spark.createDataFrame(marks, MARKS), delay="400 days")
    told.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()), key=str)
    assert got == loop(events, marks)


def test_timers_let_states_lapse(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    day = lambda n: START + dt.timedelta(days=n)
    events = [[(1, day(1), "active", "asking", 100)], [(2, day(60), "active", "asking", 5)], [(2, day(61), "sold", "asking", 5)], [(1, day(61), "active", "asking", 50)]]
    marks = [(7, 1, START), (7, 2, START)]
    for lot in events:
        spark.createDataFrame(lot, EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = notice_stream(stream, spark.createDataFrame(marks, MARKS), delay="2 days").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    got = [tuple(r)[:5] for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert got == [(7, 2, day(61), "off_market", 1)]
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] > 0


def test_only_what_is_announced_meets_marks(spark):
    """Events that tell nobody are not carried to every mark of their listing."""
    events = spark.createDataFrame([(1, START + dt.timedelta(hours=i), "active", "asking", 100) for i in range(50)] + [(1, START + dt.timedelta(hours=60), "sold", "asking", 100)], EVENTS)
    marks = spark.createDataFrame([(a, 1, START) for a in range(40)], MARKS)
    assert mark_notices(events, marks).count() == 40
    # the windows over a listing's events stand under the join: nothing of them is done for each mark
    plan = mark_notices(events, marks)._jdf.queryExecution().optimizedPlan().toString()
    joined = plan.index("Join Inner")
    assert "lag(status" not in plan[:joined] and "lag(status" in plan[joined:]

"""Alerts against a plain loop over files, listings and runs; and as a stream, replays included."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from mizan.operators import alerts as A
from mizan.streaming.alerts import alert_stream

RATINGS = ["great", "good", "fair", "high", "overpriced"]
NEWS = "listing_id long, kind string, at timestamp_ntz, make_key string, model_key string, trim_key string, city string, fuel string, gearbox string, asking_price long, model_year int, mileage_km int, rating string, accident string"
START = dt.datetime(2024, 5, 1, 6)


def passes(f, car):
    for name, column in (("make", "make_key"), ("model", "model_key"), ("trim", "trim_key"), ("city", "city"), ("fuel", "fuel"), ("gearbox", "gearbox")):
        if name in f and car[column] not in f[name]:
            return False
    for name, column in (("price", "asking_price"), ("year", "model_year"), ("mileage", "mileage_km")):
        if name in f and (car[column] is None or car[column] < f[name].get("min", 0) or car[column] > f[name].get("max", 1 << 60)):
            return False
    if "deal" in f and (car["rating"] is None or RATINGS.index(car["rating"]) > RATINGS.index(f["deal"])):
        return False
    return not (f.get("no_accident") and car["accident"] == "had_accident")


@pytest.fixture(scope="module")
def data():
    rng = random.Random(5)
    pick = lambda *x: rng.choice(x)
    cars = []
    for i in range(240):
        make = pick("a", "b", "c", None)
        car = {"listing_id": i % 150, "kind": pick("indexed", "indexed", "dropped"), "at": START + dt.timedelta(minutes=3 * i), "make_key": make, "model_key": make and f"{make}.{pick(1, 2)}", "trim_key": None, "city": pick("x", "y", None), "fuel": pick("N", "R"), "gearbox": pick("O", "F", None), "asking_price": pick(None, 0, 1, 900, 1_000, 5_000, 70_000), "model_year": pick(1390, 1400, None), "mileage_km": pick(10, 90_000), "rating": pick(*RATINGS, None), "accident": pick("had_accident", "none", None)}
        cars.append(car)
    options = [{"make": ["a", "b"]}, {"model": ["a.1"], "deal": "good"}, {"city": ["x"], "price": {"max": 1_000}}, {"price": {"min": 900}}, {"price": {"max": 0}}, {"price": {"min": 1, "max": 5_000}, "no_accident": True}, {"fuel": ["N"]}, {}, {"no_accident": True, "year": {"min": 1395}}, {"mileage": {"max": 50}, "no_accident": False}]
    files = [{"file_id": i, "account": i % 7, "search": json.dumps({"v": 1, "filters": options[i % len(options)]}), "watermark": START - dt.timedelta(hours=i % 3), "muted": i % 11 == 0} for i in range(40)]
    bad = ["", "null", "{", '{"v":2,"filters":{}}', '{"v":1}', '{"v":1,"filters":{"make":[]}}', '{"v":1,"filters":{"make":"a"}}', '{"v":1,"filters":{"odd":1}}', '{"v":1,"filters":{"price":{}}}', '{"v":1,"filters":{"price":{"min":2,"max":1}}}', '{"v":1,"filters":{"deal":"super"}}', None]
    files += [{"file_id": 100 + i, "account": 99, "search": b, "watermark": START - dt.timedelta(hours=5), "muted": None} for i, b in enumerate(bad)]
    return cars, files


def loop(cars, files, digests, now, cap, gap):
    """One run, file by file."""
    end = now - dt.timedelta(seconds=60)
    day = lambda t: (t + dt.timedelta(hours=3, minutes=30)).date()
    today = {}
    for g in digests:
        today[g["account"]] = today.get(g["account"], 0) + (day(g["at"]) == day(now))
    out, told = [], dict(today)
    for f in sorted(files, key=lambda f: f["file_id"]):
        last = max((g["at"] for g in digests if g["file_id"] == f["file_id"]), default=None)
        row = {"file_id": f["file_id"], "new": 0, "good": 0, "drops": 0, "watermark": f["watermark"]}
        if f["watermark"] >= end or today.get(f["account"], 0) >= cap or last and last > now - dt.timedelta(minutes=gap):
            out.append(row | {"outcome": "waiting"})
            continue
        if f["file_id"] >= 100:
            out.append(row | {"outcome": "unreadable", "watermark": end})
            continue
        hits = {}
        for c in cars:
            if f["watermark"] < c["at"] <= end and passes(json.loads(f["search"])["filters"], c):
                h = hits.setdefault(c["listing_id"], [False, False])
                h[0] |= c["kind"] == "indexed"
                h[1] |= c["rating"] in ("great", "good")
        row |= {"new": sum(h[0] for h in hits.values()), "good": sum(h[0] and h[1] for h in hits.values()), "drops": sum(not h[0] for h in hits.values())}
        if f["muted"] or row["good"] + row["drops"] == 0:
            out.append(row | {"outcome": "quiet", "watermark": end})
        elif told.get(f["account"], 0) < cap:
            told[f["account"]] = told.get(f["account"], 0) + 1
            out.append(row | {"outcome": "notified", "watermark": end})
        else:
            out.append(row | {"outcome": "deferred"})
    return out


def plain(rows):
    return sorted((r["file_id"], r["outcome"], r["new"], r["good"], r["drops"], r["watermark"]) for r in rows)


def frame(spark, rows, schema):
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(r[c] for c in names) for r in rows], schema)


FILES = "file_id long, account long, search string, watermark timestamp_ntz, muted boolean"


def test_run_equals_the_loop(spark, data):
    cars, files = data
    now = START + dt.timedelta(hours=9)
    digests = [{"account": 1, "file_id": 8, "at": now - dt.timedelta(minutes=30)}, {"account": 2, "file_id": 2, "at": now - dt.timedelta(hours=7)}]
    got = A.run(frame(spark, files, FILES), frame(spark, cars, NEWS), frame(spark, digests, "account long, file_id long, at timestamp_ntz"), F.lit(now).cast("timestamp_ntz"), daily_cap=3, gap_minutes=60)
    want = loop(cars, files, digests, now, 3, 60)
    assert plain(got.collect()) == plain(want) and {r["outcome"] for r in want} == {"waiting", "unreadable", "quiet", "notified", "deferred"}


def test_matches_meet_once(spark, data):
    cars, files = data
    searches = A.stored_searches(frame(spark, files, FILES))
    got = A.matches(searches, frame(spark, cars, NEWS)).select("file_id", "listing_id", "at").collect()
    want = [(f["file_id"], c["listing_id"], c["at"]) for f in files if f["file_id"] < 100 for c in cars if passes(json.loads(f["search"])["filters"], c)]
    assert sorted(map(tuple, got)) == sorted(want) and searches.filter("readable").count() == 40
    assert A.matches(searches.limit(0), frame(spark, cars, NEWS)).count() == 0


def test_stream_equals_runs_one_after_another(spark, data, tmp_path):
    cars, files = data
    source, rules = f"{tmp_path}/in", {"daily_cap": 3, "gap_minutes": 100}
    lots = [cars[:60], cars[60:120], cars[120:180], cars[180:]]
    digests, state, want = [], [dict(f) for f in files], []
    for k, lot in enumerate(lots):
        frame(spark, lot, NEWS).coalesce(1).write.mode("append").parquet(source)
        now = lot[-1]["at"] + dt.timedelta(seconds=60)
        out = loop([c for some in lots[: k + 1] for c in some], state, digests, now, 3, 100)
        by = {r["file_id"]: r for r in out}
        digests += [{"account": f["account"], "file_id": f["file_id"], "at": now} for f in state if by[f["file_id"]]["outcome"] == "notified"]
        state = [f | {"watermark": by[f["file_id"]]["watermark"]} for f in state]
        want += [(r["file_id"], now, r["new"], r["good"], r["drops"]) for r in out if r["outcome"] == "notified"]
    stream = spark.readStream.schema(NEWS).option("maxFilesPerTrigger", 1).parquet(source)
    store, writer = alert_stream(stream, frame(spark, files, FILES), f"{tmp_path}/alerts", **rules)
    writer.trigger(availableNow=True).start().awaitTermination()
    told = lambda: sorted((r.file_id, r["at"], r.new, r.good, r.drops) for r in store.digests().collect())
    assert told() == sorted(want) and len(want) > 20
    assert sorted((r.file_id, r.watermark) for r in store.files(4).collect()) == sorted((f["file_id"], f["watermark"]) for f in state)
    # the last batch comes again: nothing is told twice, and no watermark moves
    store.handle(frame(spark, lots[3], NEWS), 3, **rules)
    assert told() == sorted(want)
    assert sorted((r.file_id, r.watermark) for r in store.files(4).collect()) == sorted((f["file_id"], f["watermark"]) for f in state)


def test_files_that_ask_the_same_and_keys_of_many_lots(spark, data, monkeypatch):
    cars, files = data
    same = [f | {"file_id": 1_000 + i, "search": json.dumps({"v": 1, "filters": {"gearbox": ["O"]}}), "watermark": START + dt.timedelta(hours=i % 2)} for i, f in enumerate(files[:40])]
    monkeypatch.setattr(A, "SEARCH_LOT", 3)
    monkeypatch.setattr(A, "NEWS_LOT", 20)
    searches = A.stored_searches(frame(spark, same, FILES))
    a, b, on = A.in_lots(A.index(searches), frame(spark, cars, NEWS).withColumn("__key", F.lit("any")), "__key", ["file_id"], ["listing_id"])
    assert a.groupBy(*on).count().agg(F.max("count")).first()[0] <= 12 and a.join(b, on).count() == 40 * len(cars)
    got = A.matches(searches, frame(spark, cars, NEWS)).count()
    assert got == 40 * sum(c["gearbox"] == "O" for c in cars)
    # one text and watermark: one search, whatever the number of files
    counts = A.told_counts(searches.select("search", "watermark"), frame(spark, cars, NEWS))
    assert counts.count() == 2

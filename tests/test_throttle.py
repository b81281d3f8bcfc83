"""Digests are spaced from the last one sent, as the reference's last_alert_at is."""

import datetime as dt
import random

from mizan.operators import events as E


def test_spaced_from_the_last_one_sent(spark):
    rng = random.Random(4)
    start = dt.datetime(2024, 3, 1)
    rows = [("hourly", start + dt.timedelta(hours=i)) for i in range(60)]
    for k in ("a", "b", None):
        rows += [(k, start + dt.timedelta(minutes=rng.randrange(6000))) for _ in range(150)]
    rows += [("a", None), ("a", None)]
    want = []
    for k in {k for k, _ in rows}:
        last, count = None, {}
        for at in sorted((t for x, t in rows if x == k), key=lambda t: (t is not None, t)):
            day = at and (at + dt.timedelta(hours=3, minutes=30)).date()
            if (at is None or last is None or at - last >= dt.timedelta(minutes=120)) and count.get(day, 0) < 8:
                last, count[day] = at, count.get(day, 0) + 1
                want.append((k, at, day, count[day]))
    df = spark.createDataFrame(rows, "k string, at timestamp_ntz").repartition(5)
    got = [tuple(r) for r in E.throttled(df, "k", "at").select("k", "at", "day", "place").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(k == "hourly" for k, *_ in got) == 24

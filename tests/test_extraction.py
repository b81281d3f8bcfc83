"""Cases of attributes, wordings and the calendar."""

import datetime as dt

from pyspark.sql import functions as F

from mizan.functions import calendar as C
from mizan.functions import extraction as X
from mizan.functions.wording import mileage_wording


def one(spark, value, *args):
    row = spark.range(1).select(value(*[F.lit(a) for a in args]).alias("v")).first()["v"]
    return row.asDict(recursive=True) if hasattr(row, "asDict") else row


def test_reads(spark):
    cases = [
        (X.mileage, "۹۱۰۰۰", "value", 91000), (X.mileage, "۱۲۰,۰۰۰ کیلومتر", "value", 120000), (X.mileage, "1000000", "unknown", None),
        (X.mileage, "99999999", "unparsed", None), (X.insurance_months, "۶ ماه", "value", 6), (X.insurance_months, "۱۳ ماه", "unparsed", None),
        (X.gearbox, "دنده‌ای", "value", "manual"), (X.fuel, "برق", "value", "electric"), (X.fuel, "آب", "unparsed", None),
        (X.body, "رنگ‌شدگی، در ۳ ناحیه", "value", "partly_repainted"), (X.body, "اوراقی", "value", "salvage"),
        (X.part, "تعیین‌نشده", "unknown", None), (X.part, "تعمیر شده", "value", "repaired"), (X.swap, "هستم", "value", True),
        (X.chassis, "هردو رنگ‌شده", "value", {"front": "repainted", "rear": "repainted"}),
        (X.chassis, "عقب ضربه‌خورده، جلو رنگ‌شده", "value", {"front": "repainted", "rear": "damaged"}),
        (X.chassis, "عقب ضربه‌خورده", "value", {"front": "intact", "rear": "damaged"}),
        (X.chassis, "عقب ضربه‌خورده، عقب رنگ‌شده", "unparsed", None), (X.chassis, "سالم و پلمپ", "value", {"front": "intact", "rear": "intact"}),
        (X.chassis, None, "unparsed", None), (X.chassis_side, "رنگ‌شده", "value", "repainted"),
        (X.model_year, "۱۳۹۲ - ۲۰۱۳", "value", {"written": "both", "sh": 1392, "ad": 2013}), (X.model_year, "قبل از ۱۳۶۶ - قبل از ۱۹۸۷", "unknown", None),
        (X.model_year, "۲۰۲۵", "value", {"written": "ad", "sh": 1404, "ad": 2025}), (X.model_year, "۱۳۹۲ - ۲۰۲۳", "unparsed", None),
    ]
    for f, text, state, value in cases:
        assert one(spark, f, text) == {"state": state, "value": value}, text


def test_wordings(spark):
    cases = [
        ("خودروی صفر، پلاک نشده", 3, "really_low", "خودروی صفر"), ("فروش: 610 کیلو متر", 610, "really_low", "610 کیلومتر"), ("۲۵ دونه کارکرد دارد", 25, "really_low", "25 دونه کارکرد"),
        ("کار کرده 40 دانه", 40, "really_low", "کارکرده 40 دانه"), ("88 کارکرد حقیقی", 88, "really_low", "88 کارکرد حقیقی"), ("12 km راه رفته", 12, "really_low", "12 km راه رفته"),
        ("با 95هزار کارکرد", 95, "thousands_text", "95 هزار"), ("۱۸۰ تا انداخته", 180, "thousands_text", "180 تا انداخته"), ("کیلومتر: 64٬000", 64, "thousands_text", "کیلومتر 64000"), ("64.000 کیلو", 64, "thousands_text", "64000 کیلو"), ("64 000 کیلومتر", 64, "thousands_text", "64 000 کیلومتر"),
        ("64,000 تومان", 64, None, None), ("95 هزار ریال", 95, None, None), ("1640 کیلومتر", 640, None, None), ("موتور صفر و در حد صفر", 7, None, None), ("صفر خشک 95 هزار", 95, None, None),
        ("0 هزار", 0, None, None), ("صفر کیلومتر", 0, "really_low", "صفر کیلومتر"), ("", 5, None, None), (None, 5, None, None), ("بدون کارکرد", None, "really_low", "بدون کارکرد"), ("سفر " * 3_000 + "9 کیلومتر", 9, "really_low", "9 کیلومتر"),
    ]
    rows = spark.createDataFrame([(i, t, n) for i, (t, n, _, _) in enumerate(cases)], "i int, t string, n int")
    got = {r.i: r.v for r in rows.select("i", mileage_wording(F.col("t"), F.col("n")).alias("v")).collect()}
    for i, (text, _, reading, wording) in enumerate(cases):
        assert (got[i] and tuple(got[i])) == (reading and (reading, wording)), text


def test_calendar(spark):
    assert one(spark, lambda t: C.solar_year(t.cast("timestamp_ntz")), "2026-03-20 20:30:00") == 1405
    assert one(spark, lambda t: C.solar_year(t.cast("timestamp_ntz")), "2026-03-20 20:29:59") == 1404
    assert one(spark, C.tehran_time_read, "۲ مهر ۱۴۰۵، ۰۹:۴۷") == dt.datetime(2026, 9, 24, 6, 17)
    assert [one(spark, C.tehran_time_read, x) for x in ("۳۱ مهر ۱۴۰۵، ۰۹:۴۷", "۳۰ اسفند ۱۴۰۴، ۰۹:۴۷", "۲ مهر ۱۴۰۵، ۲۵:۴۷", "x", None)] == [None] * 5
    assert one(spark, C.tehran_time_read, "۳۰ اسفند ۱۴۰۳، ۰۰:۰۰") == dt.datetime(2025, 3, 19, 20, 30)
    assert one(spark, lambda a, b: C.ago(a.cast("timestamp_ntz"), b.cast("timestamp_ntz")), "2024-01-01 00:00:00", "2024-01-02 23:00:00") == {"unit": "day", "n": 1}

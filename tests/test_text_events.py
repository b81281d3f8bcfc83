import datetime as dt

from pyspark.sql import functions as F

from mizan.functions import text as T
from mizan.operators import events as E


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


def test_numbers(spark):
    for text, want in [("۱٬۲۳۴", 1234), ("12,34", None), ("1,234,567", 1234567), ("", None), ("٤٢", 42), ("1234567890123456", 1234567890123456), ("9007199254740992", None), ("1" * 40, None)]:
        assert one(spark, T.whole_number(F.col("t")), t=text) == want, text
    assert one(spark, T.price_read(F.col("t")), t="توافقی")["kind"] == "negotiable"
    assert one(spark, T.price_read(F.col("t")), t="۸۰۰٬۰۰۰٬۰۰۰ تومان").asDict() == {"kind": "asking", "amount": 800_000_000}
    assert one(spark, T.price_read(F.col("t")), t="1,111")["kind"] == "placeholder"


def test_text_forms(spark):
    assert one(spark, T.normalised(F.col("t")), t=" كتاب‌هاي  ABC ") == "کتاب های abc"
    assert one(spark, T.search_form(F.col("t")), t="پژو206") == "پژو 206"
    assert one(spark, T.swapped(F.col("a"), F.col("b")), a="abcd", b="abdc") is True
    assert one(spark, T.swapped(F.col("a"), F.col("b")), a="abcd", b="abce") is False
    assert one(spark, T.engine_cc(F.col("t")), t="موتور 1.6 litre") == 1600
    assert one(spark, T.masked_phones(F.col("t")), t="call 0912 345 6789 now") == "call ••• now"


def test_typo_is_corrected(spark):
    docs = spark.createDataFrame([("corolla white",)] * 20 + [("camry",)], "t string")
    plan = T.text_plan("corolal 99", T.vocabulary(docs, "t"), 21)
    assert plan == {"terms": [("corolla", True), ("99", True)], "corrections": {"corolal": "corolla"}, "unmatched": []}


def test_price_changes(spark):
    at = lambda n: dt.datetime(2024, 1, n)
    seen = [(1, at(1), "asking", 100), (1, at(2), "asking", 100), (1, at(3), "negotiable", None), (1, at(4), "asking", 90), (2, at(1), "asking", 5)]
    df = spark.createDataFrame(seen, "listing_id long, observed_at timestamp, price_type string, asking_price long")
    changes = E.price_changes(df)
    assert changes.count() == 4
    assert [(r["listing_id"], r["asking_price"], r["last_asking_price"]) for r in E.price_drops(changes).collect()] == [(1, 90, 100)]


def test_difference_makes_one_of_the_other(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "key int, v string")
    b = spark.createDataFrame([(1, "x"), (2, ""), (4, "q")], "key int, v string")
    assert {r["key"]: r["action"] for r in E.difference(a, b, "key").collect()} == {2: "update", 3: "delete", 4: "insert"}

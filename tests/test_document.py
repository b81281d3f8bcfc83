"""Cases of flags, notices and inboxes."""

from pyspark.sql import functions as F

from mizan.functions import extraction as X
from mizan.operators import document as D


def test_risk_flags(spark):
    schema = "i int, price_type string, inst boolean, km int, body string, front string, rear string, no_rating string, facts array<struct<field: string, value: string>>"
    rows = [
        (1, "installment", True, None, "intact", "intact", None, "price_outlier", [("paint", "spots"), ("chassis", "damaged"), ("accident", "had_accident")]),
        (2, "asking", True, 5, None, None, None, "installment_price", []),
        (3, None, None, 5, "salvage", None, None, None, [("price_meaning", "starting_from"), ("plate", "free_zone")]),
    ]
    flags = D.risk_flags("price_type", "inst", "km", "body", "front", "rear", "no_rating", F.col("facts"))
    got = {r["i"]: r["f"] for r in spark.createDataFrame(rows, schema).select("i", flags.alias("f")).collect()}
    assert got == {1: ["down_payment", "mileage_unread", "paint_conflict", "chassis_conflict", "accident_conflict", "price_outlier"], 2: ["installments", "installment_guard"], 3: ["starting_from", "free_zone"]}


def test_drops_inbox_and_shown_sizes(spark):
    marks = spark.createDataFrame([(1, 7, 2), (2, 7, 4)], "account_id long, listing_id long, seen_id long")
    changes = spark.createDataFrame([(7, 2, "asking", 80, 90), (7, 3, "asking", 70, 80), (7, 4, "negotiable", None, 70), (7, 5, "asking", 75, 70)], "listing_id long, id long, price_type string, asking_price long, last_asking_price long")
    assert [tuple(r) for r in D.drop_notices(marks, changes).collect()] == [(1, 7, 3, 80, 70, 5)]
    notices = spark.createDataFrame([(1, 10, 1), (2, 10, 1), (3, 20, 1), (4, 5, 2)], "id long, created_at long, account_id long")
    assert [r["id"] for r in D.after_in_inbox(notices, 1, 3).collect()] == [2, 1]
    assert D.after_in_inbox(notices, 1, 4).collect() == []
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    row = spark.range(1).select(
        D.adjustment(F.lit(0.1), F.lit(1.0)).alias("a"), D.adjustment(F.lit(0.001), F.lit(1.0)).alias("b"),
        D.seen_baseline(at("2024-01-01 10:00:00"), at("2024-01-01 08:00:00"), at("2024-01-01 10:04:00")).cast("string").alias("c"),
        D.source_state(F.lit("enabled"), F.lit(None).cast("timestamp_ntz"), at("2024-01-01")).alias("d"), D.target_status(F.lit(3), 2).alias("e"),
        X.with_text_price(F.lit("asking"), F.lit(5), F.array(F.lit("down_payment"))).alias("f"),
    ).first()
    assert round(row["a"], 3) == 10.517 and row["b"] is None and row["c"] == "2024-01-01 08:00:00" and row["d"] == "delayed" and row["e"] == "missed"
    assert tuple(row["f"]) == ("installment", None, 5)

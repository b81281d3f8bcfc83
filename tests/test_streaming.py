"""A stream's changes are those of the batch form, over several micro-batches."""

import tempfile

from mizan.operators import events as E
from mizan.streaming import changes as S

ROWS = "listing_id long, observed_at timestamp_ntz, price_type string, asking_price long"


def test_price_changes_and_marks(spark):
    data = [(i % 3, f"2024-01-{1 + i // 3:02d} 00:00:00", "negotiable" if i % 5 == 4 else "asking", None if i % 5 == 4 else 100 - 10 * (i // 6)) for i in range(18)]
    rows = spark.createDataFrame(data, "listing_id long, at string, price_type string, asking_price long").selectExpr("listing_id", "cast(at as timestamp_ntz) as observed_at", "price_type", "asking_price")
    root = tempfile.mkdtemp(prefix="spark-stream-")
    for low, high in ((0, 9), (9, 18)):
        spark.createDataFrame(rows.collect()[low:high], rows.schema).coalesce(1).write.mode("append").parquet(root + "/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(root + "/in")
    S.price_change_stream(stream).writeStream.format("parquet").option("path", root + "/out").option("checkpointLocation", root + "/c1").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(root + "/out")
    want = E.price_changes(rows).select(*got.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    seen = {}
    S.rebuild_marked(stream, "listing_id", lambda keys, n: seen.update({n: sorted(r[0] for r in keys.collect())}), root + "/c2").awaitTermination()
    assert seen == {0: [0, 1, 2], 1: [0, 1, 2]}

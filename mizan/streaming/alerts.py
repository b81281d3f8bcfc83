"""Alerts over a stream of news: a matching run a micro-batch, its watermarks in versioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from mizan.operators import alerts


class AlertStore:
    """Tables under root: files by version, news and digests by micro-batch.

    A micro-batch reads version n and writes version n + 1, its own news and its own digests, each over what an earlier
    try left; so a batch that comes again, in part or whole, changes nothing and tells nobody twice."""

    def __init__(self, spark: SparkSession, root: str, files: DataFrame, news: DataFrame):
        self.spark, self.root = spark, root
        self.news_schema = news.schema
        self.digest_schema = "account {a}, file_id {f}, at timestamp_ntz, new long, good long, drops long".format(a=files.schema["account"].dataType.simpleString(), f=files.schema["file_id"].dataType.simpleString())
        self.file_schema = files.schema
        files.write.mode("ignore").parquet(self._path("files", 0))

    def _path(self, table: str, batch: int) -> str:
        return f"{self.root}/{table}/batch={batch}"

    def files(self, version: int) -> DataFrame:
        return self.spark.read.schema(self.file_schema).parquet(self._path("files", version))

    def news(self, batch: int) -> DataFrame:
        """All news up to a batch; the run's windows select among them by instant."""
        return self.spark.read.schema(self.news_schema).option("basePath", f"{self.root}/news").parquet(*[self._path("news", k) for k in range(batch + 1)])

    def digests(self, before: int | None = None) -> DataFrame:
        """What was sent by all batches, or by those before one."""
        if before == 0:
            return self.spark.createDataFrame([], self.digest_schema)
        paths = [f"{self.root}/digests/batch=*"] if before is None else [self._path("digests", k) for k in range(before)]
        return self.spark.read.schema(self.digest_schema).parquet(*paths)

    def handle(self, rows: DataFrame, batch: int, **rules: int) -> None:
        """One micro-batch. Its run's now is the margin after its newest row, so it depends on the rows alone."""
        rows.write.mode("overwrite").parquet(self._path("news", batch))
        newest = self.spark.read.schema(self.news_schema).parquet(self._path("news", batch)).agg(F.max("at")).first()[0]
        files, before = self.files(batch), self.digests(batch)
        if newest is None:
            files.write.mode("overwrite").parquet(self._path("files", batch + 1))
            before.limit(0).write.mode("overwrite").parquet(self._path("digests", batch))
            return
        now = F.lit(newest).cast("timestamp_ntz") + F.make_interval(secs=F.lit(rules.get("margin", alerts.MARGIN)))
        oldest = files.agg(F.min("watermark")).first()[0]  # nothing older is asked for, so its row groups are not read
        alerts.run(files, self.news(batch).filter(F.col("at") > F.lit(oldest)), before, now, **rules).write.mode("overwrite").parquet(f"{self.root}/runs/batch={batch}")
        done = self.spark.read.parquet(f"{self.root}/runs/batch={batch}")
        told = done.filter("outcome = 'notified'").select("account", "file_id", now.alias("at"), "new", "good", "drops")
        told.write.mode("overwrite").parquet(self._path("digests", batch))
        done.select(*self.file_schema.names).write.mode("overwrite").parquet(self._path("files", batch + 1))


def alert_stream(news: DataFrame, files: DataFrame, root: str, **rules: int) -> tuple[AlertStore, DataStreamWriter]:
    """The store under root, and a writer to start: news(listing_id, kind, at, ...), a stream, against files."""
    store = AlertStore(news.sparkSession, root, files, news)
    return store, news.writeStream.foreachBatch(lambda rows, n: store.handle(rows, n, **rules)).option("checkpointLocation", f"{root}/checkpoint")

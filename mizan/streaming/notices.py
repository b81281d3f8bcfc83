"""Notices about marked listings as a stream: a state for each mark, with timers that let it lapse."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from mizan.operators.notices import LAPSE_DAYS, OFF, ON, followed

#: Instants are microseconds in states and between the steps.
NOTICE = "account long, listing_id long, at long, kind string, version int, previous_price long, price long"
SEEN = "at long, status string, price_type string, asking_price long, last_price long, version int"


def _order(at, status, price_type, price) -> tuple:
    """The order of a mark's events, as the batch form's sort has it; nulls first."""
    return (at, status is not None, status or "", price_type is not None, price_type or "", price is not None, price or 0)


class MarkProcessor(StatefulProcessor):
    """One mark's state: its last event, the last asking price and how many changes were announced.

    An event that is not after the last one, in that order, is known already or too late: it is passed over, so a batch
    that comes again tells nothing twice. A timer clears the state once the watermark is past its lapse; an event that
    comes so late before the watermark does starts it anew as well, as in the batch form."""

    def __init__(self, lapse_days: int = LAPSE_DAYS):
        self.lapse = lapse_days * 86_400_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", SEEN)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        account, listing = key
        last = self.seen.get() if self.seen.exists() else None
        first = last
        for r in sorted(rows, key=lambda r: _order(r.at_us, r.status, r.price_type, r.asking_price)):
            if last is not None and _order(r.at_us, r.status, r.price_type, r.asking_price) <= _order(*last[:4]):
                continue
            known = last is not None and r.at_us - last[0] <= self.lapse
            status, price, version = (last[1], last[4], last[5]) if known else (None, None, 0)
            asked = r.asking_price if r.price_type == "asking" else None
            if r.at_us > r.marked_us:
                if asked is not None and price is not None and asked < price:
                    yield Row(account=account, listing_id=listing, at=r.at_us, kind="price_drop", version=None, previous_price=price, price=asked)
                kind = "off_market" if status == ON and r.status in OFF else "relisted" if status in OFF and r.status == ON else None
                if kind:
                    version += 1
                    yield Row(account=account, listing_id=listing, at=r.at_us, kind=kind, version=version, previous_price=None, price=asked if kind == "relisted" else None)
            last = (r.at_us, r.status, r.price_type, r.asking_price, price if asked is None else asked, version)
        if last is not None and last is not first:
            self.seen.update(last)
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer((last[0] + self.lapse) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def notice_stream(events: DataFrame, marks: DataFrame, *, lapse_days: int = LAPSE_DAYS, delay: str = "1 hour") -> DataFrame:
    """The notices of mark_notices() for a stream of events and a table of marks.

    Events later than the delay are dropped by the watermark. The session needs the RocksDB state store
    (spark.sql.streaming.stateStore.providerClass), which keeps the states of all marks on disk, not in memory."""
    timed = events.withColumn("observed_at", F.col("observed_at").cast("timestamp")).withWatermark("observed_at", delay)
    both = followed(timed, marks.withColumn("marked_at", F.col("marked_at").cast("timestamp")))
    long = lambda c: F.col(c).cast("long").alias(c)
    keyed = both.select(long("account"), long("listing_id"), "observed_at", F.unix_micros("observed_at").alias("at_us"), F.unix_micros("marked_at").alias("marked_us"), "status", "price_type", long("asking_price"))
    told = keyed.groupBy("account", "listing_id").transformWithState(MarkProcessor(lapse_days), NOTICE, "append", "eventTime")
    return told.withColumn("at", F.timestamp_micros("at").cast("timestamp_ntz"))

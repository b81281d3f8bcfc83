"""Streams: price changes with what each listing was last seen at, and rows that are marked to be built anew."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

CHANGE = "listing_id long, observed_at timestamp_ntz, price_type string, asking_price long, previous_type string, previous_price long, last_asking_price long"
SEEN = "observed_at timestamp_ntz, price_type string, asking_price long, last_asking_price long"


def _same(a, b) -> bool:
    return (pd.isna(a) and pd.isna(b)) or (not pd.isna(a) and not pd.isna(b) and a == b)


def _changes(key, parts, state):
    """A listing's changes among new observations, in their order; its last state is one row, whatever its history."""
    last = state.get if state.exists else None
    rows = sorted((r for part in parts for r in part.itertuples(index=False)), key=lambda r: (r.observed_at, r.price_type, -1 if pd.isna(r.asking_price) else r.asking_price))
    out = []
    for r in rows:
        if last is not None and r.observed_at < last[0]:
            continue  # later than what is known already
        price = None if pd.isna(r.asking_price) else int(r.asking_price)
        if last is None or r.price_type != last[1] or not _same(price, last[2]):
            out.append((key[0], r.observed_at, r.price_type, price, last and last[1], last and last[2], last and last[3]))
        last = (r.observed_at, r.price_type, price, price if price is not None else last and last[3])
    if last is not None:
        state.update(last)
    made = pd.DataFrame(out, columns=[c.split()[0] for c in CHANGE.split(", ")])
    yield made.astype({c: "Int64" for c in ("asking_price", "previous_price", "last_asking_price")})


def price_change_stream(observations: DataFrame) -> DataFrame:
    """observations(listing_id, observed_at, price_type, asking_price), a stream, as its changes: the first observation of a
    listing and each that differs from the one before. An observation older than the listing's last one is not taken."""
    keyed = observations.select("listing_id", "observed_at", "price_type", "asking_price").groupBy("listing_id")
    return keyed.applyInPandasWithState(_changes, CHANGE, SEEN, "append", GroupStateTimeout.NoTimeout)


def rebuild_marked(marks: DataFrame, key: str, rebuild: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Starts a query that hands each batch's different marked keys, and the batch's number, to rebuild; a batch that comes
    again after a failure has the same number."""
    return marks.writeStream.foreachBatch(lambda rows, n: rebuild(rows.select(key).distinct(), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

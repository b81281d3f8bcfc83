"""Orders, keyset pages, capped counts, facets and option counts of a search."""

from __future__ import annotations

import base64
import binascii
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mizan.operators import predicates as P

#: (column, ascending) terms of each order; nulls always come last and listing_id, descending, ends every order.
SORTS = {
    "best_deal": [("price_gap", True), ("listed_at", False)],
    "price_asc": [("asking_price", True)],
    "price_desc": [("asking_price", False)],
    "mileage_asc": [("mileage_km", True)],
    "newest": [("listed_at", False)],
    "year_desc": [("model_year", False)],
}


def terms(sort: str) -> list[tuple[str, bool]]:
    return [*SORTS[sort], ("listing_id", False)]


def order_by(sort: str) -> list[Column]:
    return [F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in terms(sort)]


def after(sort: str, key: dict) -> Column:
    """Rows that come after a row with these values: for each term, equal before it and further on in it. A null is the
    tail: nothing but later terms comes after it, and it comes after every value."""
    ways, equal = [], F.lit(True)
    for column, up in terms(sort):
        value = key[column]
        if value is not None:
            beyond = F.col(column) > F.lit(value) if up else F.col(column) < F.lit(value)
            ways.append(equal & (F.coalesce(beyond, F.lit(False)) | F.col(column).isNull()))
        equal = equal & F.col(column).eqNullSafe(F.lit(value))
    out = ways[0]
    for w in ways[1:]:
        out = out | w
    return out


def page(rows: DataFrame, sort: str, key: dict | None = None, size: int = P.PAGE) -> DataFrame:
    """The next rows of an order: a top-k, so no full sort; size is bounded by MOST."""
    some = rows.filter(after(sort, key)) if key else rows
    return some.orderBy(*order_by(sort)).limit(min(size, P.MOST))


def sort_key(sort: str) -> Column:
    """The row's key as texts, one for each term."""
    return F.array(*[F.col(c).cast("string") for c, _ in terms(sort)])


def encode_cursor(sort: str, key: dict, total: int | None = None, exact: bool = True) -> str:
    """A page's end as URL-safe text."""
    body = json.dumps({"v": 1, "s": sort, "k": {k: str(v) if v is not None and not isinstance(v, int | float) else v for k, v in key.items()}, "n": total, "e": exact}, sort_keys=True)
    return base64.urlsafe_b64encode(body.encode()).decode().rstrip("=")


def decode_cursor(text: str, sort: str) -> dict | None:
    """The key in a cursor; None if it is unreadable, of another order, or lacks a term."""
    try:
        body = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
    except (binascii.Error, ValueError):
        return None
    names = {c for c, _ in terms(sort)}
    right = isinstance(body, dict) and body.get("v") == 1 and body.get("s") == sort and isinstance(body.get("k"), dict)
    return body if right and set(body["k"]) == names else None


def capped_count(rows: DataFrame, cap: int) -> DataFrame:
    """One row (n, exact): no more than cap + 1 rows are counted."""
    n = rows.limit(cap + 1).agg(F.count("*").alias("n"))
    return n.select(F.least("n", F.lit(cap)).cast("long").alias("n"), (F.col("n") <= cap).alias("exact"))


FACETS = {"make": "make_key", "body_type": "body_type", "gearbox": "gearbox", "fuel": "fuel", "city": "city", "seller": "seller_type", "source": "source_id", "deal": "rating"}


def facets(rows: DataFrame, search: P.Search, clock: P.Clock) -> DataFrame:
    """(facet, value, n): counts of each facet's values under all other filters. Nulls are no value.

    One scan for all facets: a row carries which of the active filters it fails, and counts for a facet if it fails
    none but the facet's own; the rows are stacked once, and counted with partial sums.
    """
    tests = P.conditions(search, clock)
    failed = [F.when(~c, F.lit(i)) for i, c in tests.items()]
    flagged = rows.withColumn("__failed", F.array_compact(F.array(*failed)) if failed else F.expr("cast(array() as array<string>)"))
    flagged = flagged.filter(F.size("__failed") <= 1)
    counted = lambda f: (F.size("__failed") == 0) | (F.col("__failed")[0] == f)
    pairs = [F.when(F.size("__failed") == 0, F.struct(F.lit(f).alias("facet"), F.col(c).cast("string").alias("value"))) if f not in tests else F.when(counted(f), F.struct(F.lit(f).alias("facet"), F.col(c).cast("string").alias("value"))) for f, c in FACETS.items()]
    each = flagged.select(F.explode(F.array_compact(F.array(*pairs))).alias("p")).select("p.facet", "p.value")
    return each.filter("value is not null").groupBy("facet", "value").agg(F.count("*").alias("n"))


def facet_totals(rows: DataFrame, clock: P.Clock) -> DataFrame:
    """(facet, n): all rows, those seen lately, and each ready-made search's, in one pass of conditional counts."""
    sums = {"total": F.count("*"), "seen": F.count_if(P.is_fresh("last_seen_at", 48, clock.column))}
    sums |= {k: F.count_if(P.searchable(s, clock)) for k, s in P.CATALOGUES.items()}
    one = rows.agg(*[v.alias(k) for k, v in sums.items()])
    return one.select(F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k in sums]), F.array(*[F.col(k) for k in sums]))).alias("facet", "n"))


def unknown_counts(rows: DataFrame, search: P.Search, clock: P.Clock, ids: tuple[str, ...]) -> DataFrame:
    """(filter, n): rows that lack the filter's value but pass all other filters."""
    sums = [F.count_if(P.searchable(search, clock, without=i) & F.col(P.FILTERS[i].column).isNull()).alias(i) for i in ids]
    one = rows.agg(*sums)
    return one.select(F.explode(F.map_from_arrays(F.array(*[F.lit(i) for i in ids]), F.array(*[F.col(i) for i in ids]))).alias("filter", "n"))


def relaxed(rows: DataFrame, search: P.Search, clock: P.Clock, top: int = 3) -> DataFrame:
    """(filter, n): how many rows would be found without each filter, the most first; one pass."""
    ids = [i for i in P.FILTERS if i in search.filters]
    one = rows.agg(*[F.count_if(P.searchable(search, clock, without=i)).alias(i) for i in ids])
    each = one.select(F.explode(F.map_from_arrays(F.array(*[F.lit(i) for i in ids]), F.array(*[F.col(i) for i in ids]))).alias("filter", "n"))
    return each.filter("n > 0").orderBy(F.desc("n"), "filter").limit(top)


def option_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(dimension, value, n) for each of the columns by one GROUPING SETS aggregate."""
    sets = [[F.col(c)] for c in columns]
    grouped = rows.groupingSets(sets, *columns).agg(F.grouping_id().alias("__g"), F.count("*").alias("n"))
    most = 1 << len(columns)
    which = F.lit(None).cast("string")
    value = F.lit(None).cast("string")
    for i, c in enumerate(columns):
        here = F.col("__g") == most - 1 - (1 << (len(columns) - 1 - i))
        which, value = F.when(here, c).otherwise(which), F.when(here, F.col(c).cast("string")).otherwise(value)
    return grouped.select(which.alias("dimension"), value.alias("value"), "n").filter("value is not null")


def with_model_rank(rows: DataFrame) -> DataFrame:
    """rows and model_rank: 1 for the model with most rows; ties share a rank and leave a gap.

    Ranked over one row a model, so the window's one partition holds catalogue entries, not listings."""
    count = rows.groupBy("model_key").agg(F.count("*").alias("__n"))
    rank = count.select("model_key", F.rank().over(Window.orderBy(F.desc("__n"))).alias("model_rank"))
    return rows.join(rank, "model_key", "left")


def home_rows(pages: list[DataFrame], show: int = 6) -> list[dict]:
    """Rows of a start page without repeats: each takes the first `show` of its page that no earlier row shows. The pages
    are a few dozen rows each and the choice is greedy, so it is made on the driver."""
    seen, out = set(), []
    for place, rows in enumerate(pages):
        for r in [r for r in rows.collect() if r["listing_id"] not in seen][:show]:
            seen.add(r["listing_id"])
            out.append({"row": place, **r.asDict()})
    return out


def similar(rows: DataFrame, listing_id: str, years: int = 2, share: float = 0.3, top: int = 6) -> DataFrame:
    """Listings of the same model, up to `years` apart and within `share` of the price, best deals first."""
    own = rows.filter(F.col("listing_id") == listing_id).select(F.col("model_key").alias("m"), F.col("model_year").alias("y"), F.col("asking_price").alias("p"))
    near = (F.col("model_key") == F.col("m")) & F.abs(F.col("model_year") - F.col("y")).between(0, years)
    near = near & F.col("asking_price").between(F.col("p") * (1 - share), F.col("p") * (1 + share)) & (F.col("listing_id") != listing_id)
    return page(rows.join(F.broadcast(own), near).drop("m", "y", "p"), "best_deal", size=top)  # own: one row

"""Predicates, filters as data, ready-made searches and the one builder of a search's condition.

What a null does is part of every predicate's contract: it fails all of them but is_not, which it passes.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from mizan.functions import text as T


def one_of(column: str, values: list) -> Column:
    """The value is in the list; an empty list keeps nothing."""
    return F.coalesce(F.col(column).isin(list(values)), F.lit(False)) if values else F.lit(False)


def between(column: str, low=None, high=None) -> Column:
    """Both ends belong to the range; an open range still wants a value."""
    found = F.col(column).isNotNull()
    if low is not None:
        found = found & (F.col(column) >= low)
    if high is not None:
        found = found & (F.col(column) <= high)
    return found


def at_least(column: str, low) -> Column:
    return F.coalesce(F.col(column) >= low, F.lit(False))


def at_most(column: str, high) -> Column:
    return F.coalesce(F.col(column) <= high, F.lit(False))


def is_true(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(False))


def is_not(column: str, value) -> Column:
    """Null passes."""
    return ~F.col(column).eqNullSafe(F.lit(value))


def within_days(column: str, days: int, now: Column) -> Column:
    return F.coalesce(F.col(column) >= now - F.make_interval(days=F.lit(days)), F.lit(False))


def years_old_at_most(column: str, years: int, year_now: int) -> Column:
    return at_least(column, year_now - years)


def mileage_for_age_at_most(km: str, year: str, per_year: int, year_now: int) -> Column:
    """The age counts half a year at least; without mileage or year nothing passes."""
    age = F.when(F.col(year).isNotNull(), F.greatest(F.lit(year_now) - F.col(year), F.lit(0.5)))
    return F.coalesce(F.col(km) <= age * per_year, F.lit(False))


def ranked(column: str, options: list[str], worst: str) -> Column:
    """The option itself and every better one; options are listed best first."""
    return one_of(column, options[: options.index(worst) + 1])


def is_fresh(column: str, hours: int, now: Column) -> Column:
    return F.coalesce(F.col(column) >= now - F.make_interval(hours=F.lit(hours)), F.lit(False))


def under(column: str, key: str) -> Column:
    """A key of the hierarchy, or one below it."""
    return (F.col(column) == key) | F.col(column).startswith(key + ".")


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


#: Fixed values, best first: ratings and body conditions as data and links hold them.
RATINGS = ["great", "good", "fair", "high", "overpriced"]
BODY_CONDITIONS = ["intact", "minor_scratches", "paintless_dent_repair", "partly_repainted", "repainted_around", "fully_repainted", "accident_damaged", "salvage"]
PAGE, MOST, POPULAR_RANK = 24, 48, 15
LOW_KM_A_YEAR = 12_000


@dataclass(frozen=True)
class Filter:
    """One filter of a search: its parameter, kind and column. Kinds: choice, ranked, range, limit, flag."""

    id: str
    param: str
    kind: str
    column: str
    options: tuple = ()


_choice = lambda i, p=None, c=None: Filter(i, p or i, "choice", c or i)
#: Every filter, with fixed parameter names (links hold them), in the order in which conditions are joined.
FILTERS = {
    f.id: f
    for f in [
        _choice("make", c="make_key"), _choice("model", c="model_key"), _choice("trim", c="trim_key"), _choice("body_type", "body"),
        Filter("year", "year", "range", "model_year"), Filter("age", "age", "limit", "model_year"),
        Filter("mileage", "km", "range", "mileage_km"), Filter("low_mileage_for_age", "lowkm", "flag", "mileage_km"),
        Filter("popular_model", "popular", "flag", "model_rank"), Filter("price", "price", "range", "asking_price"),
        Filter("deal", "deal", "ranked", "rating", tuple(RATINGS)), _choice("gearbox"), _choice("fuel"),
        Filter("engine_volume", "cc", "range", "engine_cc"), _choice("origin"), _choice("country"), _choice("colour", c="colour_family"),
        Filter("paint_free", "nopaint", "flag", "paint_free"), Filter("body_condition", "bodystate", "ranked", "body_condition", tuple(BODY_CONDITIONS)),
        _choice("engine_condition", "engine"), _choice("gearbox_condition", "gearboxstate"), _choice("chassis", c="chassis_condition"),
        Filter("no_accident", "noaccident", "flag", "accident"), Filter("no_replaced_parts", "noreplaced", "flag", "replaced_parts"),
        Filter("not_ride_hailing", "notaxi", "flag", "ride_hailing"), Filter("no_free_zone_plate", "nofreezone", "flag", "plate"),
        Filter("insurance", "insurance", "limit", "insurance_months"), Filter("swap", "swap", "flag", "offers_swap"),
        Filter("installments", "installments", "flag", "offers_installments"), _choice("city"), _choice("district"),
        _choice("seller", c="seller_type"), _choice("source", c="source_id"), Filter("has_photo", "photo", "flag", "photo_count"),
        Filter("posted_within", "posted", "limit", "listed_at"),
    ]
}
#: Flags that a null passes, and the value that fails them.
NEGATIVE = {"no_accident": "had_accident", "no_replaced_parts": "some", "not_ride_hailing": "used", "no_free_zone_plate": "free_zone"}


@dataclass(frozen=True)
class Clock:
    """What a search takes as now."""

    now: str
    year: int

    @property
    def column(self) -> Column:
        return F.lit(self.now).cast("timestamp_ntz")


def condition(f: Filter, value, clock: Clock) -> Column:
    """The condition of one filter with a value that has been checked."""
    if f.kind == "choice":
        return one_of(f.column, value)
    if f.kind == "ranked":
        return ranked(f.column, list(f.options), value)
    if f.kind == "range":
        return between(f.column, value.get("min"), value.get("max"))
    if f.id == "age":
        return years_old_at_most(f.column, value, clock.year)
    if f.id == "insurance":
        return at_least(f.column, value)
    if f.id == "posted_within":
        return within_days(f.column, value, clock.column)
    if f.id == "low_mileage_for_age":
        return mileage_for_age_at_most(f.column, "model_year", LOW_KM_A_YEAR, clock.year)
    if f.id == "popular_model":
        return at_most(f.column, POPULAR_RANK)
    if f.id == "has_photo":
        return at_least(f.column, 1)
    if f.id in NEGATIVE:
        return is_not(f.column, NEGATIVE[f.id])
    return is_true(f.column)


@dataclass(frozen=True)
class Search:
    """A search: words, filters by id, order and the ready-made search it came from."""

    filters: dict = field(default_factory=dict)
    sort: str = "best_deal"
    words: str = ""
    catalogue: str | None = None


#: Ready-made searches: filters and an order each.
CATALOGUES = {
    "expert_pick": Search({"deal": "good", "no_accident": True, "low_mileage_for_age": True}),
    "great_deals": Search({"deal": "great", "price": {"max": 50_000}}),
    "clean_and_easy": Search({"no_accident": True, "deal": "fair", "has_photo": True}),
    "family": Search({"body_type": ["PROMO", "STANDARD"], "age": 4}),
    "low_mileage": Search({"low_mileage_for_age": True}, "mileage_asc"),
    "automatic": Search({"gearbox": ["O"], "deal": "fair"}),
    "ride_hailing": Search({"price": {"max": 30_000}, "age": 5, "fuel": ["N", "R"]}, "price_asc"),
    "insured": Search({"insurance": 4, "price": {"min": 1}}),
    "newest": Search({"posted_within": 300}, "newest"),
}


def conditions(search: Search, clock: Clock, without: str | None = None) -> dict[str, Column]:
    """A condition for each filter of the search, in the filters' own order, but for the one left out."""
    return {i: condition(f, search.filters[i], clock) for i, f in FILTERS.items() if i in search.filters and i != without}


def searchable(search: Search, clock: Clock, *, seen: str | None = None, hours: int = 48, without: str | None = None, terms: list[tuple[str, bool]] | None = None, text: str = "search_text") -> Column:
    """The single condition that page, count, facets and alerts share; seen: also fresh by that column. A search's words
    must all be in the text column: terms as text_plan made them, else each word as a prefix and each number as it is."""
    fresh = [is_fresh(seen, hours, clock.column)] if seen else []
    said = [T.matches(T.lexemes(F.col(text)), T.plain_terms(search.words) if terms is None else terms)] if search.words else []
    return all_of([*conditions(search, clock, without).values(), *fresh, *said])


def checked(f: Filter, value):
    """The value a filter can use, or None: 1 to 50 different choices, an option, ordered ends, a whole number over 0."""
    if f.kind == "choice":
        found = sorted(set(value)) if isinstance(value, list | tuple) else [value]
        return found if 0 < len(found) <= 50 and all(isinstance(x, str) and x for x in found) else None
    if f.kind == "ranked":
        return value if value in f.options else None
    if f.kind == "range":
        low, high = value.get("min"), value.get("max")
        right = all(x is None or isinstance(x, int) and x >= 0 for x in (low, high)) and (low is not None or high is not None)
        return {k: v for k, v in (("min", low), ("max", high)) if v is not None} if right and (low is None or high is None or low <= high) else None
    if f.kind == "limit":
        return value if isinstance(value, int) and not isinstance(value, bool) and value > 0 else None
    return True if value is True else None


def canonical(search: Search) -> Search:
    """Filters that can be used, choices sorted, words single-spaced; a bare ready-made search stands for its filters."""
    base = CATALOGUES.get(search.catalogue or "")
    if base and not search.filters and not search.words:
        search = Search(base.filters, base.sort, "", search.catalogue)
    kept = {i: v for i, f in FILTERS.items() if i in search.filters and (v := checked(f, search.filters[i])) is not None}
    return Search(kept, search.sort, " ".join(search.words.split()), search.catalogue)


_DIGITS = str.maketrans("۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩", "01234567890123456789")


def from_params(params: list[tuple[str, str]]) -> tuple[Search, list[str]]:
    """A search from URL parameters, and the names of those that cannot be used. Ranges are low..high; choices are
    repeated or separated by commas; digits may be of any of three scripts."""
    by_param = {f.param: f for f in FILTERS.values()}
    seen: dict[str, list[str]] = {}
    for k, v in params:
        seen.setdefault(k, []).append(v.translate(_DIGITS).strip())
    filters, ignored = {}, []
    whole = lambda x: int(x) if x.isdigit() else None
    for k, values in seen.items():
        if k in ("q", "sort", "catalogue"):
            continue
        f = by_param.get(k)
        value = None
        if f and f.kind == "choice":
            value = checked(f, [x for v in values for x in v.split(",")])
        elif f and f.kind == "range" and ".." in values[0]:
            low, _, high = values[0].partition("..")
            broken = (low and whole(low) is None) or (high and whole(high) is None)
            value = None if broken else checked(f, {"min": whole(low) if low else None, "max": whole(high) if high else None})
        elif f and f.kind == "limit":
            value = checked(f, whole(values[0]))
        elif f and f.kind == "flag":
            value = True if values[0] in ("1", "true") else None
        elif f:
            value = checked(f, values[0])
        if value is None:
            ignored.append(k)
        else:
            filters[f.id] = value
    first = lambda k, d: seen.get(k, [d])[0]
    return canonical(Search(filters, first("sort", "best_deal"), first("q", ""), first("catalogue", "") or None)), ignored


def to_params(search: Search) -> list[tuple[str, str]]:
    """URL parameters that from_params reads back; the default order is left out."""
    out = []
    for i, f in FILTERS.items():
        v = search.filters.get(i)
        if v is None:
            continue
        if f.kind == "choice":
            out.append((f.param, ",".join(v)))
        elif f.kind == "range":
            out.append((f.param, f"{v.get('min', '')}..{v.get('max', '')}"))
        else:
            out.append((f.param, "1" if v is True else str(v)))
    out += [("q", search.words)] if search.words else []
    out += [("sort", search.sort)] if search.sort != "best_deal" else []
    return out + ([("catalogue", search.catalogue)] if search.catalogue else [])

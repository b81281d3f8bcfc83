"""Filters' truth tables, canonical searches, keyset pages against a full sort, facets against direct counts."""

import pytest

from mizan.operators import paging as G
from mizan.operators import predicates as P

CLOCK = P.Clock("2024-06-30 00:00:00", 2024)
ROWS = [
    ("A", 2021, 20_000, 800, "great", None, "2024-06-29 22:00:00"),
    ("B", 2016, 180_000, 1_200, "good", "had_accident", "2024-06-25 00:00:00"),
    ("C", 2023, 10_000, None, None, "none", "2024-06-10 00:00:00"),
    ("D", 2024, 5_000, 950, "fair", "none", "2024-06-28 18:00:00"),
    ("E", None, None, 400, "overpriced", "none", "2024-05-01 00:00:00"),
]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame(ROWS, "listing_id string, model_year int, mileage_km int, asking_price long, rating string, accident string, at string")
    return df.selectExpr("*", "cast(at as timestamp_ntz) as listed_at")


@pytest.mark.parametrize(
    ("filters", "kept"),
    [
        ({"year": {"min": 2021}}, "ACD"),
        ({"deal": "good"}, "AB"),
        ({"no_accident": True}, "ACDE"),
        ({"mileage": {"max": 20_000}}, "ACD"),
        ({"price": {"min": 800, "max": 950}}, "AD"),
        ({"age": 1}, "CD"),
        ({"low_mileage_for_age": True}, "ACD"),
        ({"posted_within": 5}, "ABD"),
        ({"deal": "fair", "no_accident": True}, "AD"),
        ({}, "ABCDE"),
    ],
)
def test_filters_keep(rows, filters, kept):
    got = rows.filter(P.searchable(P.Search(filters), CLOCK)).collect()
    assert "".join(sorted(r["listing_id"] for r in got)) == kept


def test_no_choice_keeps_nothing(rows):
    assert rows.filter(P.one_of("rating", [])).count() == 0


def test_search_survives_its_parameters():
    search = P.canonical(P.Search({"make": ["b", "a", "a"], "price": {"max": 5}, "no_accident": True, "age": 3}, "newest", "  two   words "))
    again, ignored = P.from_params(P.to_params(search))
    assert again == search and ignored == [] and search.filters["make"] == ["a", "b"]


def test_unusable_parameters_are_named():
    search, ignored = P.from_params([("price", "۹..5"), ("km", "..۱۰"), ("deal", "best"), ("what", "x")])
    assert search.filters == {"mileage": {"max": 10}} and sorted(ignored) == ["deal", "price", "what"]


@pytest.mark.parametrize("sort", list(G.SORTS))
def test_pages_are_the_full_sort(spark, sort):
    df = spark.range(300).selectExpr(
        "cast(id as string) listing_id", "if(id % 17 = 0, null, cast(2000 + id % 25 as int)) model_year", "if(id % 11 = 0, null, cast(id * 313 % 40 as int)) mileage_km",
        "if(id % 9 = 0, null, id * 7919 % 90) asking_price", "if(id % 3 = 0, null, cast(id * 37 % 61 as int)) price_gap", "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, cast(id % 50 as int)) listed_at",
    ).cache()
    want = [r["listing_id"] for r in df.orderBy(*G.order_by(sort)).collect()]
    got, key = [], None
    while len(got) < 96:
        page = G.page(df, sort, key, 48).collect()
        got += [r["listing_id"] for r in page]
        key = {c: page[-1][c] for c, _ in G.terms(sort)}
    assert got == want[: len(got)]
    tail = df.orderBy(*G.order_by(sort)).collect()[-10]  # among nulls, where the order has them
    rest = G.page(df, sort, {c: tail[c] for c, _ in G.terms(sort)}).collect()
    assert [r["listing_id"] for r in rest] == want[-9:]


def test_cursor():
    text = G.encode_cursor("newest", {"listed_at": "2024-01-01", "listing_id": "7"}, 10)
    assert G.decode_cursor(text, "newest")["k"]["listing_id"] == "7"
    assert G.decode_cursor(text, "price_asc") is None and G.decode_cursor("%%", "newest") is None


def test_capped_count(spark):
    assert G.capped_count(spark.range(10), 5).first().asDict() == {"n": 5, "exact": False}
    assert G.capped_count(spark.range(5), 5).first().asDict() == {"n": 5, "exact": True}

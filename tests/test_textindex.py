"""The index and a scan of all texts find the same, and the index reads little."""

import pytest
from pyspark.sql import functions as F

from mizan.functions import text as T
from mizan.operators.textindex import TextIndex
from mizan.session import new_folder, table
from tests.compare import SF_DIR

TERMS = [[("th", False)], [("le", False), ("de", False)], [("a", False), ("e", True), ("12", True)], [("die", True), ("un", False)], [("zzzz", False)], [("é", False), ("a", False)], [("a", False), ("a", False)], []]


@pytest.fixture(scope="module")
def docs(spark):
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "Then the THE then ۱۲ e a"), (-3, "le de"), (-4, "éa 日本 日"), (None, "the le de")], "doc_id long, text string")
    return table(spark, SF_DIR, "documents").select("doc_id", "text").unionByName(odd).cache()


@pytest.fixture(scope="module")
def index(spark, docs):
    return TextIndex.build(docs.withColumns({"id": F.lit(1), "word": F.lit("x"), "head": F.lit("y")}), "doc_id", "text", new_folder(spark, "index"))


@pytest.mark.parametrize("terms", TERMS)
def test_search_equals_scan(docs, index, terms):
    some = docs.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list(T.lexemes(F.col("text"))))).alias("w")).filter(F.size("w") > 0)
    want = some.filter(T.matches(F.col("w"), terms)).select("doc_id")
    assert sorted(str(r[0]) for r in index.search(terms).collect()) == sorted(str(r[0]) for r in want.collect())


def test_other_scripts(index):
    assert [r.id for r in index.search([("日", False)]).collect()] == [-4] and [r.id for r in index.search([("日本", True)]).collect()] == [-4]


def test_only_the_asked_folder_is_read(index):
    plan = index.term("th", False)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(head" in plan and " = l20)" in plan and "GreaterThanOrEqual(word,th)" in plan


def test_vocabulary(docs, index):
    want = docs.filter("doc_id >= 0").select("doc_id", F.explode(T.lexemes(F.col("text"))).alias("w")).filter("w = 'the'").count()
    assert index.rows().filter("word = 'the' and id >= 0").select("id").distinct().count() == want


def test_no_rows(spark, docs):
    empty = TextIndex.build(docs.limit(0), "doc_id", "text", new_folder(spark, "index"))
    assert empty.search([("a", False)]).collect() == [] and empty.vocabulary().collect() == []


def test_postings_stand_once_and_vocabulary_counts_them(spark, tmp_path):
    rows = spark.createDataFrame([(1, "red car"), (1, "car blue"), (2, "car"), (None, "car")], "doc_id long, text string")
    made = TextIndex.build(rows, "doc_id", "text", f"{tmp_path}/again")
    assert made.rows().filter("id is not null").count() == 4
    assert {r.word: r.df for r in made.vocabulary().collect()} == {"red": 1, "car": 2, "blue": 1}
    assert "distinct" not in made.vocabulary()._jdf.queryExecution().optimizedPlan().toString().lower()

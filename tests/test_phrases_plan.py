"""Phrases are looked for in one reading of the texts."""

from mizan.functions import text as T
from mizan.plans import text_queries
from pyspark.sql import functions as F


def test_texts_are_read_once(spark):
    run, _ = text_queries.QUERIES["ext15_stated_facts"]
    plan = run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("\\p{M}") == 1 and "lambdafunction" not in plan


def test_one_pass_folds_as_three(spark):
    texts = ["ۀيىك‌aـb ٠۰1x\t\nİΣ\x0b\x85c", "", None, " é²ـ ", "9ـa‌ي"]
    d = spark.createDataFrame([(t,) for t in texts], "text string")
    three = F.translate(T.to_latin_digits(T.with_persian_letters(F.col("text"))), T.HEH_FROM + T.ZWNJ + T.TATWEEL, T.HEH_TO + " ")
    assert [r[0] for r in d.select(T.folded(F.col("text"))).collect()] == [r[0] for r in d.select(F.lower(three)).collect()]
    spaced = F.trim(F.regexp_replace(F.lower(three), "\\s+", " "))
    parted = F.regexp_replace(F.regexp_replace(spaced, "(\\p{L})(\\p{N})", "$1 $2"), "(\\p{N})(\\p{L})", "$1 $2")
    want = d.select(F.trim(F.regexp_replace(parted, "[^\\p{L}\\p{N}\\p{M}]+", " "))).collect()
    assert [r[0] for r in d.select(T.search_form(F.col("text"))).collect()] == [r[0] for r in want]

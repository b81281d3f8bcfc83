"""Facts that texts state in words: phrases of a glossary found natively, the longest first, with what negates them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from mizan.functions import text as T
from mizan.session import stored

#: Words that negate what follows them and what stands before them, and how far they reach.
NEGATES_NEXT = ("no", "not", "without", "بدون", "غیر", "نه")
NEGATES_LAST = ("نیست", "ندارد", "نشده", "نداشته", "نمیباشد")
REACH = 3
#: What a span is in a text: a phrase, or a word that negates what follows or what stands before.
PHRASE, NEXT, LAST = 0, 1, 2


def ordered_words(text: Column) -> Column:
    """A text's words in their order, in the form that searches compare; none for null."""
    return F.array_remove(F.split(T.search_form(F.coalesce(text, F.lit(""))), " "), "")


def glossary_of(rows: DataFrame) -> DataFrame:
    """(phrase, n, fact, value, otherwise) of rows(phrase, fact, value, otherwise): phrases in the words' form and their
    length; `otherwise` is the value when the phrase is negated, null if that says nothing. Phrases without words are left
    out; of rows that say different things by one phrase for one fact, the least value is kept."""
    words = ordered_words(F.col("phrase"))
    some = rows.select(F.array_join(words, " ").alias("phrase"), F.size(words).alias("n"), "fact", "value", "otherwise").filter("n > 0")
    return some.groupBy("phrase", "n", "fact").agg(F.min(F.struct("value", "otherwise")).alias("s")).select("phrase", "n", "fact", "s.*")


def spans(docs: DataFrame, key: str, text: str, wanted: DataFrame, most: int) -> DataFrame:
    """(key, first, last, phrase, role) of every phrase of wanted(phrase, role) in docs, overlapping ones too. Each place of a
    text offers its word and those after it; where that word begins a phrase, its runs of one to `most` words meet the
    phrases. Both are equi-joins; a frequent word or phrase is a skewed join, which Spark splits."""
    w = docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), ordered_words(F.col(text)).alias("w"))
    shifted = [F.col("w"), *[F.slice("w", n, F.greatest(F.size("w"), F.lit(1))) for n in range(2, most + 1)]]
    places = w.select("key", F.posexplode(F.arrays_zip(*[c.alias(f"w{n}") for n, c in enumerate(shifted)])).alias("at", "x")).select("key", "at", "x.*")
    begins = wanted.select(F.split("phrase", " ")[0].alias("w0")).distinct()
    runs = F.array(*[F.concat(*[c for i in range(n) for c in (F.lit(" "), F.col(f"w{i}"))][1:]) for n in range(1, most + 1)])  # null past the end
    offered = places.join(begins, "w0", "left_semi").select("key", "at", F.posexplode(runs).alias("more", "phrase"))
    return offered.join(wanted, "phrase").select("key", (F.col("at") + 1).alias("first"), (F.col("at") + F.col("more") + 1).alias("last"), "phrase", "role")


@F.pandas_udf(ArrayType(IntegerType()))
def chosen(first: pd.Series, last: pd.Series, role: pd.Series) -> pd.Series:
    """For each span of a text 0, or 1 if it is one of those left when the text is read from its beginning and the longest
    phrase is taken at each place, the next one beginning after it; 2 if a word negates it, too. One pass over a text's
    spans."""

    def of(a: np.ndarray, b: np.ndarray, role: np.ndarray) -> np.ndarray:
        kept, end = [], 0
        phrases = np.flatnonzero(role == PHRASE)
        order = phrases[np.lexsort((-b[phrases], a[phrases]))]
        for i, start, stop in zip(order.tolist(), a[order].tolist(), b[order].tolist(), strict=True):
            if start > end:
                kept.append(i)
                end = stop
        out = np.zeros(len(a), np.int32)
        if kept:
            start, stop = a[kept].astype(int), b[kept].astype(int)
            back = np.maximum(np.append(0, stop[:-1]) + 1, start - REACH)
            on = np.minimum(np.append(start[1:], stop[-1] + REACH + 1) - 1, stop + REACH)
            among = lambda where, low, high: np.searchsorted(where, high, "right") > np.searchsorted(where, low, "left")
            out[kept] = 1 + (among(np.sort(a[role == NEXT]), back, start - 1) | among(np.sort(a[role == LAST]), stop + 1, on))
        return out

    return pd.Series([of(*map(np.asarray, x)) for x in zip(first, last, role, strict=True)], dtype=object)


def stated_facts(docs: DataFrame, key: str, text: str, glossary: DataFrame) -> DataFrame:
    """(key, fact, value, first, last, phrase, negated, agreed) of docs(key, text), whose keys differ.

    Phrases are found longest first and do not overlap. One is negated by a word of NEGATES_NEXT among the REACH words
    before it, or of NEGATES_LAST among those after it, as far as the next phrase; then it states `otherwise`, or nothing.
    agreed: whether all of a text's phrases for the fact give one value. Null and empty texts state nothing; texts are
    read whole, once. What is gathered is one text's phrases and negating words, which are found like phrases. No
    glossary: no rows. The glossary is written; only its longest phrase is collected, a number."""
    known = stored(glossary_of(glossary), "glossary")
    most = known.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first()["n"]
    if not most:
        return docs.sparkSession.createDataFrame([], f"key {docs.schema[key].dataType.simpleString()}, fact string, value string, first int, last int, phrase string, negated boolean, agreed boolean")
    wanted = known.select("phrase").distinct().withColumn("role", F.lit(PHRASE))
    for role, words in ((NEXT, NEGATES_NEXT), (LAST, NEGATES_LAST)):
        wanted = wanted.unionByName(docs.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, words))).alias("phrase"), F.lit(role).alias("role")))
    by = spans(docs, key, text, wanted, most).groupBy("key").agg(F.collect_list(F.struct("first", "last", "phrase", "role")).alias("s"))
    each = by.withColumn("taken", chosen("s.first", "s.last", "s.role")).select("key", F.explode(F.arrays_zip("s", "taken")).alias("x"))
    kept = each.filter("x.taken > 0").select("key", "x.s.first", "x.s.last", "x.s.phrase", (F.col("x.taken") == 2).alias("negated"))
    said = kept.join(known.drop("n"), "phrase")
    said = said.withColumn("value", F.when(F.col("negated"), F.col("otherwise")).otherwise(F.col("value"))).filter("value is not null")
    same = Window.partitionBy("key", "fact")
    agreed = F.min("value").over(same) == F.max("value").over(same)
    return said.select("key", "fact", "value", "first", "last", "phrase", "negated", agreed.alias("agreed"))

"""Text and number functions as columns: digits, letters, amounts, tokens, typo correction."""

from __future__ import annotations

import math
import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Digits of three scripts, letters with one form each, marks that are not shown.
PERSIAN, ARABIC, LATIN = "۰۱۲۳۴۵۶۷۸۹", "٠١٢٣٤٥٦٧٨٩", "0123456789"
LETTERS_FROM, LETTERS_TO = "يىك", "ییک"
HEH_FROM, HEH_TO = "ۀ", "ه"
HIDDEN = "\\u061C\\u200E\\u200F\\u202A-\\u202E\\u2066-\\u2069"
ZWNJ, TATWEEL = "‌", "ـ"
GROUP_MARKS = ",،٫٬"
MOST_WHOLE = 2**53 - 1


def to_latin_digits(text: Column) -> Column:
    return F.translate(text, PERSIAN + ARABIC, LATIN * 2)


def to_persian_digits(text: Column) -> Column:
    """Latin digits alone; others stay as they are."""
    return F.translate(text, LATIN, PERSIAN)


def without_hidden(text: Column) -> Column:
    """Without marks that only steer the direction of writing."""
    return F.regexp_replace(text, f"[{HIDDEN}]", "")


def with_persian_letters(text: Column) -> Column:
    return F.translate(text, LETTERS_FROM, LETTERS_TO)


def folded(text: Column) -> Column:
    """One form of letters and digits, no tatweel, half-spaces as spaces, lower case. One pass over the characters: none
    becomes another that is folded, too."""
    return F.lower(F.translate(text, LETTERS_FROM + PERSIAN + ARABIC + HEH_FROM + ZWNJ + TATWEEL, LETTERS_TO + LATIN * 2 + HEH_TO + " "))


def normalised(text: Column) -> Column:
    """folded, with single spaces."""
    return F.trim(F.regexp_replace(folded(text), "\\s+", " "))


def search_form(text: Column) -> Column:
    """normalised, with letters and digits parted. Compatibility forms are folded by nfkc() before, where they occur. Spaces
    go with the marks, in one pass."""
    parted = F.regexp_replace(F.regexp_replace(folded(text), "(\\p{L})(\\p{N})", "$1 $2"), "(\\p{N})(\\p{L})", "$1 $2")
    return F.trim(F.regexp_replace(parted, "[^\\p{L}\\p{N}\\p{M}]+", " "))


def nfkc(text: Column) -> Column:
    """Unicode compatibility composition; Spark has no such function, so a pandas one runs on Arrow batches."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def fold(x):
        return x.str.normalize("NFKC")

    return fold(text)


def lexemes(text: Column) -> Column:
    """A text's different words in its search form; none for null."""
    return F.array_distinct(F.filter(F.split(search_form(F.coalesce(text, F.lit(""))), " "), lambda w: w != ""))


def whole_number(text: Column) -> Column:
    """A whole number, plain or grouped by exactly three digits; null for anything else and beyond 2**53 - 1."""
    plain = F.trim(to_latin_digits(without_hidden(text)))
    marks = "[" + GROUP_MARKS + "]"
    right = plain.rlike("^[0-9]+$") | plain.rlike(f"^[0-9]{{1,3}}({marks}[0-9]{{3}}){{1,}}$")
    value = F.when(right, F.regexp_replace(plain, marks, "").try_cast("decimal(38,0)"))
    return F.when(value <= MOST_WHOLE, value.cast("long"))


MOST_TOMAN, PLACEHOLDER = 999_999_999_999_999, 10_000_000


def price_read(text: Column) -> Column:
    """struct(kind, amount): asking with its amount; negotiable; placeholder for amounts too small to be meant."""
    bare = F.trim(F.regexp_replace(to_latin_digits(without_hidden(text)), "(تومان|toman)", ""))
    n = whole_number(bare)
    kind = F.when(bare.rlike("(?i)^(توافقی|negotiable)$"), "negotiable").when(n < PLACEHOLDER, "placeholder").when(n <= MOST_TOMAN, "asking").otherwise("unparsed")
    return F.struct(kind.alias("kind"), F.when(kind == "asking", n).alias("amount"))


def same_price(kind_a: Column, a: Column, kind_b: Column, b: Column) -> Column:
    return kind_a.eqNullSafe(kind_b) & a.eqNullSafe(b)


def grouped(n: Column) -> Column:
    """A whole number in groups of three."""
    return F.format_number(n, 0)


def three_digits(n: Column) -> Column:
    """A whole number to three significant digits."""
    unit = F.pow(F.lit(10.0), F.greatest(F.floor(F.log10(n.cast("double"))) - 2, F.lit(0)))
    return F.when(n > 0, (F.round(n / unit) * unit).cast("long")).otherwise(n)


def engine_cc(text: Column) -> Column:
    """Engine volume in cc from cc or litres beside their unit; null outside 500 to 9,000."""
    plain = F.lower(to_latin_digits(text))
    cc = F.regexp_extract(plain, "(?<![0-9])([0-9]{3,4}) ?(?:cc|سی ?سی)", 1)
    litres = F.regexp_extract(plain, "(?<![0-9.])([0-9](?:[./][0-9])?) ?(?:litre|liter|لیتر)", 1)
    n = F.when(cc != "", cc.cast("int")).when(litres != "", F.round(F.regexp_replace(litres, "/", ".").cast("double") * 1000).cast("int"))
    return F.when(n.between(500, 9000), n)


def masked_phones(text: Column) -> Column:
    """Runs of 8 or more digits, spaces and dashes between them allowed, are hidden."""
    return F.regexp_replace(to_latin_digits(text), "(?<![0-9])\\+?[0-9](?:[ -]?[0-9]){7,}", "•••")


def shown_evidence(text: Column) -> Column:
    """Null where it is long or looks like a way to get in touch."""
    touch = to_latin_digits(text).rlike("[0-9](?:[ -]?[0-9]){6,}|@|https?://|www\\.")
    return F.when((F.length(text) <= 200) & ~touch, text)


def slug(text: Column, most: int = 80) -> Column:
    """Letters and digits of lower-cased text, anything else a single hyphen; `item` if nothing is left."""
    made = F.regexp_replace(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", "-"), "^-+|-+$", "")
    cut = F.regexp_replace(F.substring(made, 1, most), "-+$", "")
    return F.when(cut == "", "item").otherwise(cut)


def title_of_slug(text: Column) -> Column:
    """The words of a slug, scripts parted."""
    words = F.regexp_replace(text, "[-_]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(words, "([a-zA-Z])([\\u0600-\\u06FF])", "$1 $2"), "([\\u0600-\\u06FF])([a-zA-Z])", "$1 $2"))


def redacted(text: Column) -> Column:
    """Log text without addresses, bearer tokens, keys and long digit runs."""
    out = F.regexp_replace(text, "(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{2,}", "[address]")
    out = F.regexp_replace(out, "(?i)bearer +[a-z0-9._~+/=-]+", "bearer [token]")
    out = F.regexp_replace(out, "(?i)(password|secret|token|api_?key)(\"?\\s*[:=]\\s*\"?)[^\\s\",}]+", "$1$2[hidden]")
    return F.regexp_replace(out, "(?<![0-9])[0-9]{10,}(?![0-9])", "[number]")


# ---- text search ---------------------------------------------------------------------------------------------------


def vocabulary(docs: DataFrame, text: str) -> DataFrame:
    """(word, df): in how many rows a word is; one exploded aggregate."""
    return docs.select(F.explode(lexemes(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))


def matches(tokens: Column, terms: list[tuple[str, bool]]) -> Column:
    """All terms are among the tokens: (word, exact), else as a prefix."""
    begins = lambda word: lambda t: t.startswith(word)  # noqa: E731  Spark reads a second parameter as an index
    out = F.lit(True)
    for word, exact in terms:
        out = out & (F.array_contains(tokens, word) if exact else F.exists(tokens, begins(word)))
    return out


def swapped(a: Column, b: Column) -> Column:
    """One is the other with two neighbouring letters exchanged."""
    n = F.length(a)
    places = F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))
    exchanged = lambda i: F.concat(F.substr(a, F.lit(1), i - 1), F.substr(a, i + 1, F.lit(1)), F.substr(a, i, F.lit(1)), F.substr(a, i + 2, n))
    return (n == F.length(b)) & (n >= 2) & (a != b) & F.exists(places, lambda i: exchanged(i) == b)


def edits_allowed(word: Column) -> Column:
    """0 under 4 letters, 1 up to 6, else 2."""
    return F.when(F.length(word) < 4, 0).when(F.length(word) < 7, 1).otherwise(2)


def corrections(asked: DataFrame, vocabulary: DataFrame, total: int) -> DataFrame:
    """(word, correction): the nearest common word of the vocabulary(word, df) for each asked(word) it lacks.

    Common: in at least 10 rows and 0.5 % of all. Near: within the allowed edits, a swap of neighbours counting one; the
    nearest, then the most frequent, then by name. Common words are at most 200 * (words a row has), whatever the
    corpus's size, since each is in 0.5 % of its rows; the few words asked are sent to them.
    """
    least = max(10, math.ceil(total / 200))
    unknown = asked.select("word").distinct().join(vocabulary.select("word"), "word", "left_anti").filter(~F.col("word").rlike("[0-9]"))
    unknown = unknown.withColumn("allowed", edits_allowed(F.col("word"))).filter("allowed > 0")
    common = vocabulary.filter(F.col("df") >= least).select(F.col("word").alias("c"), "df")
    near = common.join(F.broadcast(unknown), F.abs(F.length("c") - F.length("word")) <= F.col("allowed"))  # words of one query
    steps = F.when(swapped(F.col("word"), F.col("c")), 1).otherwise(F.levenshtein("word", "c"))
    found = near.withColumn("steps", steps).filter("steps <= allowed")
    best = found.groupBy("word").agg(F.min_by("c", F.struct("steps", -F.col("df"), "c")).alias("correction"))
    return unknown.select("word").join(best, "word", "left")


def plain_terms(query: str) -> list[tuple[str, bool]]:
    """The different words of a query in their order, each with whether it must be met exactly, as numbers must."""
    folded = unicodedata.normalize("NFKC", query).translate(str.maketrans(PERSIAN + ARABIC + LETTERS_FROM, LATIN * 2 + LETTERS_TO)).lower()
    return [(w, w.isdigit()) for w in dict.fromkeys(re.findall(r"[^\W\d_]+|\d+", folded))]


def text_plan(query: str, vocabulary: DataFrame, total: int, tries: int = 3) -> dict:
    """terms [(word, exact)], corrections and unmatched words of a query: numbers are exact, words are prefixes, a word
    that is no prefix of any known one is corrected, three of them at most. Only the query's own words are collected."""
    words = [w for w, _ in plain_terms(query)]
    if not words:
        return {"terms": [], "corrections": {}, "unmatched": []}
    spark = vocabulary.sparkSession
    asked = spark.createDataFrame([(w,) for w in words], "word string")
    known = {r["word"] for r in F.broadcast(asked).join(vocabulary.select(F.col("word").alias("v")), F.col("v").startswith(F.col("word"))).select("word").distinct().collect()}
    lost = [w for w in words if w not in known and not w.isdigit()]
    fixed = {}
    if lost:
        tried = spark.createDataFrame([(w,) for w in lost[:tries]], "word string")
        fixed = {r["word"]: r["correction"] for r in corrections(tried, vocabulary, total).collect() if r["correction"]}
    terms = [(fixed.get(w, w), w.isdigit() or w in fixed) for w in words if w in known or w in fixed or w.isdigit()]
    return {"terms": terms, "corrections": fixed, "unmatched": [w for w in lost if w not in fixed]}

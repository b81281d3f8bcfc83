"""What a text says about a mileage that is written too low for its car: that it is right, or that it counts thousands.

The text is cut into words and whole numbers; the written figure, or a thousand times it, is looked up among them, and the
kinds of the words beside it decide.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mizan.functions import text as T

#: Words by what they say next to a figure.
KILOMETRE = ["کیلومتر", "کیلومتری"]
SHORT_KILOMETRE = ["کیلو", "km"]
DRIVEN = ["کارکرد", "کارکرده"]
WORK = ["کار"]
PIECES = ["دونه", "دانه"]
COUNTED = ["تا"]
THOUSAND = ["هزار"]
COVERED = ["انداخته"]
GENUINE = ["واقعی", "حقیقی"]
MONEY = ["تومان", "تومن", "ریال", "میلیون", "تخفیف"]
CAR = ["ماشین", "خودرو", "خودروی", "اتومبیل"]
NOTHING, DRY, WITHOUT, MOVED, HAS_NOT, WAY, GONE = "صفر", "خشک", "بدون", "حرکت", "نداشته", "راه", "رفته"
#: Two words that are one.
JOINED = {"کیلو متر": "کیلومتر", "کیلو متری": "کیلومتری", "کار کرد": "کارکرد", "کار کرده": "کارکرده"}
MOST_LETTERS = 120


def tokens(text: Column) -> Column:
    """Words and whole numbers in their order: one form of letters and digits, groups of three digits put together."""
    plain = F.lower(T.with_persian_letters(T.to_latin_digits(T.without_hidden(text))))
    plain = F.translate(F.translate(plain, T.ZWNJ, " "), T.TATWEEL, "")
    whole = F.regexp_replace(plain, "(?<=[0-9])[,٬.](?=[0-9]{3}(?![0-9]))", "")
    split = F.regexp_replace(F.regexp_replace(whole, "([\\p{L}\\p{M}])([0-9])", "$1 $2"), "([0-9])([\\p{L}\\p{M}])", "$1 $2")
    spaced = F.concat(F.lit(" "), F.regexp_replace(split, "[^\\p{L}\\p{M}\\p{N}]+", " "), F.lit(" "))
    for two, one in JOINED.items():
        spaced = F.replace(spaced, F.lit(f" {two} "), F.lit(f" {one} "))
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def mileage_wording(text: Column, written: Column) -> Column:
    """struct(reading, wording): `really_low` if the text says that so few kilometres are meant, `thousands_text` if it
    counts thousands of them; null where it says neither, or both, or where text or figure is missing. wording: the words
    that say so, the first ones if there are several."""
    w = F.coalesce(tokens(text), F.expr("cast(array() as array<string>)"))
    any_of = lambda word, *kinds: word.isin([x for k in kinds for x in k])
    figure, thousand = written.cast("string"), (written * 1_000).cast("string")

    def said(words: Column, i: Column) -> Column:
        """struct(reading, first, last) of what stands at place i of the words, or null."""
        at = lambda k: F.coalesce(F.try_element_at(words, F.greatest(k, F.lit(1)).cast("int")), F.lit(""))
        before = F.when(i > 1, at(i - 1)).otherwise("")
        here, next1, next2 = at(i), at(i + 1), at(i + 2)
        made = lambda reading, back, on: F.struct(F.lit(reading).alias("reading"), (i - back).alias("first"), (i + on).alias("last"))
        low = lambda back, on: made("really_low", back, on)
        high = lambda back, on: made("thousands_text", back, on)
        is_figure = here == figure
        never = (here == NOTHING) & any_of(next1, [DRY], KILOMETRE, SHORT_KILOMETRE)
        some = F.when(never, low(0, 1)).when((here == NOTHING) & any_of(before, CAR), low(1, 0))
        some = some.when((here == WITHOUT) & any_of(next1, DRIVEN), low(0, 1)).when((here == MOVED) & (next1 == HAS_NOT), low(0, 1))
        # the figure and what is counted by it
        some = some.when(is_figure & any_of(next1, KILOMETRE), low(0, 1))
        some = some.when(is_figure & any_of(next1, PIECES) & any_of(next2, DRIVEN, WORK, KILOMETRE), low(0, 2))
        some = some.when(is_figure & any_of(next1, PIECES) & any_of(before, DRIVEN), low(1, 1))
        some = some.when(is_figure & any_of(next1, DRIVEN) & any_of(next2, GENUINE), low(0, 2))
        some = some.when(is_figure & (next1 == WAY) & (next2 == GONE), low(0, 2))
        some = some.when(is_figure & any_of(next1, SHORT_KILOMETRE) & (next2 == WAY) & (at(i + 3) == GONE), low(0, 3))
        counts = F.coalesce(written >= 1, F.lit(False))
        some = some.when(counts & is_figure & any_of(next1, THOUSAND) & ~any_of(next2, MONEY), high(0, 1))
        some = some.when(counts & is_figure & any_of(next1, COUNTED) & any_of(next2, DRIVEN, WORK, KILOMETRE, SHORT_KILOMETRE, COVERED), high(0, 2))
        # a thousand times the figure, in one number or with its last group apart
        for shown, on, after in ((here == thousand, 0, next1), (is_figure & (next1 == "000"), 1, next2)):
            beside = any_of(before, DRIVEN, KILOMETRE, SHORT_KILOMETRE)
            some = some.when(counts & shown & ~any_of(after, MONEY) & beside, high(1, on)).when(counts & shown & any_of(after, DRIVEN, KILOMETRE, SHORT_KILOMETRE), high(0, on + 1))
        return some

    def decided(words: Column) -> Column:
        every = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1))), lambda i: said(words, i)), lambda x: x.isNotNull())
        readings = F.array_distinct(F.transform(every, lambda x: x["reading"]))
        first = F.get(every, F.lit(0))
        wording = F.array_join(F.slice(words, first["first"], first["last"] - first["first"] + 1), " ")
        return F.when(F.size(readings) == 1, F.struct(first["reading"].alias("reading"), F.substring(wording, 1, MOST_LETTERS).alias("wording")))

    return F.get(F.transform(F.array(w), decided), F.lit(0))  # so the words are made once

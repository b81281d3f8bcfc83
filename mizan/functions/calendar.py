"""The Solar Hijri calendar, times as they are written in Tehran, and how long ago something was."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mizan.functions import text as T
from mizan.operators.events import tehran_day

#: Leap years of the 33-year cycle, one year and its first day, names of the months.
LEAPS, CYCLE = (1, 5, 9, 13, 17, 22, 26, 30), 33
ANCHOR_YEAR, ANCHOR_DAY = 1403, "2024-03-20"
MONTHS = ("فروردین", "اردیبهشت", "خرداد", "تیر", "مرداد", "شهریور", "مهر", "آبان", "آذر", "دی", "بهمن", "اسفند")


def leap_days_before(year):
    """Leap years before `year`, a number or a column, counted from some year: with eight leap years in each cycle at the
    places above, one more whenever the quotient steps."""
    part = (year * len(LEAPS) + 21) / CYCLE
    return F.floor(part) if isinstance(year, Column) else int(part)


def is_leap(year: Column) -> Column:
    return (year % CYCLE).isin(*LEAPS)


def first_day(year: Column) -> Column:
    """The date on which a Solar Hijri year begins."""
    days = (year - ANCHOR_YEAR) * 365 + leap_days_before(year) - leap_days_before(ANCHOR_YEAR)
    return F.date_add(F.lit(ANCHOR_DAY).cast("date"), days.cast("int"))


def solar_day(day: Column) -> Column:
    """struct(year, month, day) of a date."""
    guess = F.year(day) - 621
    year = F.when(day >= first_day(guess), guess).otherwise(guess - 1)
    nth = F.datediff(day, first_day(year))
    month = F.when(nth < 186, F.floor(nth / 31) + 1).otherwise(F.floor((nth - 186) / 30) + 7)
    of_month = F.when(nth < 186, nth % 31 + 1).otherwise((nth - 186) % 30 + 1)
    return F.when(day.isNotNull(), F.struct(year.cast("int").alias("year"), month.cast("int").alias("month"), of_month.cast("int").alias("day")))


def solar_year(instant: Column) -> Column:
    """The Solar Hijri year of the day in Tehran on which an instant in UTC falls."""
    return solar_day(tehran_day(instant))["year"]


def tehran_time_read(text: Column) -> Column:
    """The instant in UTC that «day month year، hh:mm» names on Tehran's clock; null where it is none or has no such day."""
    plain = F.trim(F.regexp_replace(T.with_persian_letters(T.to_latin_digits(T.without_hidden(text))), "\\s+", " "))
    part = lambda i: F.regexp_extract(plain, "^([0-9]{1,2}) (\\S+) ([0-9]{4}) ?، ?([0-9]{1,2}):([0-9]{2})$", i)
    day, year, hour, minute = (F.nullif(part(i), F.lit("")).cast("int") for i in (1, 3, 4, 5))
    month = F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), part(2)), F.lit(0).cast("long")).cast("int")
    before = F.when(month <= 7, (month - 1) * 31).otherwise(186 + (month - 7) * 30)
    date = F.date_add(first_day(year), (before + day - 1).cast("int"))
    length = F.when(month <= 6, 31).when(month <= 11, 30).otherwise(29 + is_leap(year).cast("int"))
    right = day.between(1, length) & (hour <= 23) & (minute <= 59)
    wall = date.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), hour, minute)
    return F.when(right, F.convert_timezone(F.lit("Asia/Tehran"), F.lit("UTC"), wall))


def ago(instant: Column, now: Column) -> Column:
    """struct(unit, n): whole minutes, hours or days since an instant, the largest unit of which one has passed; `now` with
    0 below a minute and for what is yet to come."""
    seconds = F.greatest(F.unix_timestamp(now) - F.unix_timestamp(instant), F.lit(0))
    made = lambda unit, size: F.struct(F.lit(unit).alias("unit"), F.floor(seconds / size).alias("n"))
    long_ago = F.when(seconds >= 86_400, made("day", 86_400)).when(seconds >= 3_600, made("hour", 3_600)).when(seconds >= 60, made("minute", 60))
    return F.when(instant.isNotNull() & now.isNotNull(), F.coalesce(long_ago, F.struct(F.lit("now").alias("unit"), F.lit(0).cast("long").alias("n"))))

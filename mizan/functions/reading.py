"""Numbers that listings state, read or refused, and rates with their intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Years that each calendar allows, the gap between them, a new car's mileage and age, the 95 % quantile.
SOLAR, GREGORIAN, CALENDAR_GAP = (1300, 1500), (1921, 2121), 621
NEW_BELOW_KM, NOT_NEW_AT_YEARS = 1_000, 3
Z95 = 1.959963984540054


def year_stated_alone(year: Column) -> Column:
    """struct(written, sh, ad) of one stated year; null where no calendar has it. A Gregorian year has its solar year too."""
    solar = year.between(*SOLAR)
    gregorian = year.between(*GREGORIAN) & (year - CALENDAR_GAP).between(*SOLAR)
    made = lambda w, sh, ad: F.struct(F.lit(w).alias("written"), sh.cast("int").alias("sh"), ad.cast("int").alias("ad"))
    return F.when(solar, made("sh", year, F.lit(None))).when(gregorian, made("ad", year - CALENDAR_GAP, year))


def years_stated_together(first: Column, second: Column) -> Column:
    """The same of two years in either order: one solar, the other Gregorian and 621 or 622 later."""
    sh, ad = F.least(first, second), F.greatest(first, second)
    right = sh.between(*SOLAR) & ad.between(*GREGORIAN) & (ad - sh).between(CALENDAR_GAP, CALENDAR_GAP + 1) & first.isNotNull() & second.isNotNull()
    return F.when(right, F.struct(F.lit("both").alias("written"), sh.cast("int").alias("sh"), ad.cast("int").alias("ad")))


def implausible_mileage(km: Column, age: Column) -> Column:
    """A new car's mileage on a car of three model years or more; an unknown age proves nothing."""
    return (km < NEW_BELOW_KM) & F.coalesce(age >= NOT_NEW_AT_YEARS, F.lit(False))


def wilson(right: Column, total: Column) -> Column:
    """struct(low, high): the 95 % score interval of right out of total; 0 to 1 where there is nothing."""
    n = F.nullif(total.cast("double"), F.lit(0.0))
    share, z2 = right / n, Z95 * Z95
    centre, scale = share + z2 / (2 * n), 1 + z2 / n
    margin = Z95 * F.sqrt(share * (1 - share) / n + z2 / (4 * n * n))
    return F.struct(F.coalesce((centre - margin) / scale, F.lit(0.0)).alias("low"), F.coalesce((centre + margin) / scale, F.lit(1.0)).alias("high"))

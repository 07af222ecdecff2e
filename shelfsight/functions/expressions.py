"""Column expressions shared by the operators. All are Spark built-ins; there is no Python UDF."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sales region of a city (upper case), city tier, season of a month.
CITY_REGION = {
    "MUMBAI": "West",
    "PUNE": "West",
    "AHMEDABAD": "West",
    "SURAT": "West",
    "DELHI": "North",
    "JAIPUR": "North",
    "BANGALORE": "South",
    "CHENNAI": "South",
    "HYDERABAD": "South",
    "KOLKATA": "East",
}
CITY_TIER = {
    "Mumbai": "Metro",
    "Delhi": "Metro",
    "Bangalore": "Metro",
    "Pune": "Tier-1",
    "Hyderabad": "Tier-1",
    "Chennai": "Tier-1",
}
SEASONS = {"Winter": (12, 1, 2), "Spring": (3, 4, 5), "Summer": (6, 7, 8)}


def lookup(key: Column, table: Mapping[str, str], default: str) -> Column:
    """Value for a key in a small fixed mapping, or the default."""
    if not table:
        return F.lit(default)
    pairs = [F.lit(part) for item in table.items() for part in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def region_of(city: Column, regions: Mapping[str, str] = CITY_REGION) -> Column:
    return lookup(F.upper(F.trim(city)), regions, "Unknown")


def tier_of(city: Column, tiers: Mapping[str, str] = CITY_TIER) -> Column:
    return lookup(city, tiers, "Tier-2")


def season_of(month: Column) -> Column:
    label = F.lit("Monsoon")
    for name, months in SEASONS.items():
        label = F.when(month.isin(*months), name).otherwise(label)
    return label


def month_name(month: Column) -> Column:
    return F.date_format(F.make_date(F.lit(2000), month, F.lit(1)), "MMMM")


def date_key(day: Column) -> Column:
    """Integer YYYYMMDD of a date."""
    return (F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)).cast("int")


def key_date(key: Column) -> Column:
    """Date of an integer YYYYMMDD."""
    year = (key / 10000).cast("int")
    month = F.pmod((key / 100).cast("int"), F.lit(100))
    return F.make_date(year, month, F.pmod(key, F.lit(100)))


def ratio(top: Column, bottom: Column) -> Column:
    """Double quotient, NULL for a zero divisor."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def percent(top: Column, bottom: Column) -> Column:
    """``100 * top / bottom`` to two decimals, NULL for a zero divisor."""
    return F.round(F.try_divide(top.cast("double") * 100.0, bottom.cast("double")), 2)


def mask_phone(phone: Column) -> Column:
    return F.concat_ws("", F.lit("XXXXX-"), F.right(phone, F.lit(4)))


def mask_email(email: Column) -> Column:
    return F.concat_ws("", F.left(email, F.lit(1)), F.lit("***@"), F.split_part(email, F.lit("@"), F.lit(2)))

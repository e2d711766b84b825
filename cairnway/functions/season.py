"""Seasonal access rules of roads and trails."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RANGE = r"^(\d{1,2})/(\d{1,2})-(\d{1,2})/(\d{1,2})"
#: Status and date columns of each travel mode.
MODE_FIELDS = {"atv": ("atv", "atv_datesopen"), "motorcycle": ("motorcycle", "motorcycle_datesopen"), "mtb": ("e_bike_class1", "e_bike_class1_dur"), "vehicle": ("highclearancevehicle", "highclearancevehicle_datesopen"), "passenger": ("passengervehicle", "passengervehicle_datesopen")}


def mode_field(mode: str) -> tuple[str, str]:
    return MODE_FIELDS.get(mode, MODE_FIELDS["vehicle"])


def date_ranges(text: Column) -> Column:
    """``MM/DD-MM/DD`` parts of a comma-separated list as array<struct<first, last>> of month * 100 + day; bad parts go."""

    def part(p: Column) -> Column:
        sm, sd, em, ed = (F.regexp_extract(p, RANGE, i).try_cast("int") for i in (1, 2, 3, 4))
        good = sm.between(1, 12) & sd.between(1, 31) & em.between(1, 12) & ed.between(1, 31)
        return F.when(good, F.struct((sm * 100 + sd).alias("first"), (em * 100 + ed).alias("last")))

    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda p: part(F.trim(p))), lambda s: s.isNotNull())


def in_season(ranges: Column, day: Column | int) -> Column:
    """Whether month * 100 + day lies in a range; ranges may wrap around the year; no ranges count as open."""
    day = F.lit(day) if isinstance(day, int) else day
    hit = lambda r: F.when(r["first"] <= r["last"], day.between(r["first"], r["last"])).otherwise((day >= r["first"]) | (day <= r["last"]))
    return (F.size(ranges) == 0) | F.exists(ranges, hit)


def check_access(status: Column, dates: Column, day: int | None = None) -> Column:
    """True open, False closed, null no data.  Seasonal rows without usable dates count as open."""
    said = F.lower(F.trim(status))
    open_now = in_season(date_ranges(dates), day) if day is not None else F.lit(True)
    return F.when(said.isNull() | (said == ""), F.lit(None).cast("boolean")).when(said != "open", False).otherwise(open_now)


def symbol_access(symbol: Column, mode: str) -> Column:
    """Access by map symbol, where no vehicle class says anything."""
    s = F.trim(symbol)
    return F.when(s.isin("1", "4"), True).when(s == "2", mode not in ("atv", "motorcycle")).when(s.isin("3", "11", "12"), False)


def row_access(status: Column, dates: Column, symbol: Column, mode: str, day: int | None = None) -> Column:
    return F.coalesce(check_access(status, dates, day), symbol_access(symbol, mode))


def parse_check_date(text: Column) -> Column:
    """``MM/DD`` -> month * 100 + day, else null."""
    m, d = (F.regexp_extract(text, r"^\s*(\d{1,2})/(\d{1,2})\s*$", i).try_cast("int") for i in (1, 2))
    return m * 100 + d

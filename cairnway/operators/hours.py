"""Opening hours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = F.col
#: Days from Sunday as periods count them, and their order in a text.
DAYS = {1: "Mo", 2: "Tu", 3: "We", 4: "Th", 5: "Fr", 6: "Sa", 0: "Su"}


def opening_hours(periods: DataFrame, key: str) -> DataFrame:
    """(key, day, open, close) -> key, hours: days of equal hours in a row share one entry; seven equal days need no name."""
    close = F.when(F.coalesce("close", F.lit("00:00")) == "00:00", "24:00").otherwise(C("close"))
    span = F.struct("open", F.concat_ws("-", C("open"), close).alias("text"))
    days = periods.groupBy(key, "day").agg(F.array_join(F.transform(F.array_sort(F.collect_list(span)), lambda s: s["text"]), ",").alias("hours"))
    week = days.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("day", "hours"))).alias("week"))
    listed = F.array(*[F.struct(F.lit(name).alias("day"), F.try_element_at("week", F.lit(d)).alias("hours")) for d, name in DAYS.items()])
    # Seven days, folded into runs of equal hours.
    empty = F.array().cast("array<struct<first:string,last:string,n:int,hours:string>>")

    def add(runs: Column, d: Column) -> Column:
        last = F.try_element_at(runs, F.lit(-1))
        fresh = F.struct(d["day"].alias("first"), d["day"].alias("last"), F.lit(1).alias("n"), d["hours"].alias("hours"))
        longer = F.struct(last["first"].alias("first"), d["day"].alias("last"), (last["n"] + 1).alias("n"), last["hours"].alias("hours"))
        return F.when((F.size(runs) > 0) & last["hours"].eqNullSafe(d["hours"]), F.concat(F.slice(runs, F.lit(1), F.size(runs) - 1), F.array(longer))).otherwise(F.concat(runs, F.array(fresh)))

    runs = F.filter(F.aggregate(listed, empty, add), lambda r: r["hours"].isNotNull())
    name = lambda r: F.when(r["n"] == 1, r["first"]).when(r["n"] == 2, F.concat_ws(",", r["first"], r["last"])).otherwise(F.concat_ws("-", r["first"], r["last"]))
    text = F.array_join(F.transform("runs", lambda r: F.concat_ws(" ", name(r), r["hours"])), "; ")
    whole = (F.size("runs") == 1) & (C("runs")[0]["n"] == 7)
    out = week.withColumn("runs", runs)
    return out.select(key, F.when(whole & (C("runs")[0]["hours"] == "00:00-24:00"), "24/7").when(whole, C("runs")[0]["hours"]).when(F.size("runs") > 0, text).alias("hours"))


def is_open(hours: Column, day: str, at: str) -> Column:
    """Whether a text of :func:`opening_hours` is open on a day at HH:MM."""
    order = list(DAYS.values())
    place = order.index(day)
    number = lambda d: F.array_position(F.array(*[F.lit(x) for x in order]), d) - 1

    def covers(entry: Column) -> Column:
        named = F.rlike(entry, F.lit("^[A-Z]"))
        days, spans = F.when(named, F.substring_index(entry, " ", 1)).otherwise("Mo-Su"), F.substring_index(entry, " ", -1)
        ranged = F.contains(days, F.lit("-"))
        on = F.when(ranged, F.lit(place).between(number(F.substring_index(days, "-", 1)), number(F.substring_index(days, "-", -1)))).otherwise(F.array_contains(F.split(days, ","), day))
        return on & F.exists(F.split(spans, ","), lambda s: F.lit(at).between(F.substring_index(s, "-", 1), F.substring_index(s, "-", -1)) & (F.lit(at) != F.substring_index(s, "-", -1)))

    return F.when(hours == "24/7", True).otherwise(F.exists(F.split(hours, "; "), covers))

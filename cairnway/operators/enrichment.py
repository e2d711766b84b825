"""Paid enrichment of places: which requests may be looked up, decided for all of them at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import first_rows

C = F.col
#: Classes of places that are businesses, and what a paid source can fill in.
BUSINESS = ("amenity", "shop", "tourism", "leisure", "office", "craft")


def paid_gate(requests: DataFrame, fields: tuple[str, ...], cap: int, business: tuple[str, ...] = BUSINESS) -> DataFrame:
    """``requests`` (rid, day, user_id, class, name, place_id and data of the cache, and ``fields``) with ``decision`` and ``gaps``.

    Only businesses with gaps are looked up.  A cached answer is used, a cached place without one is a known miss; guests and places
    without a name are not looked up, nor is anyone after a day's first ``cap`` lookups, in order of rid.  Only those ``cap`` rows of a
    day meet in one place.
    """
    gaps = F.array_compact(F.array(*[F.when(F.coalesce(C(c), F.lit("")) == "", c) for c in fields]))
    before = (
        F.when(~F.coalesce(C("class").isin(*business), F.lit(False)), "not_business").when(F.size("gaps") == 0, "complete").when(C("place_id").isNotNull() & C("data").isNotNull(), "cache_hit")
        .when(C("place_id").isNotNull(), "known_miss").when(C("user_id").isNull(), "guest").when(F.coalesce("name", F.lit("")) == "", "unnamed")
    )
    rows = requests.withColumn("gaps", gaps).withColumn("before", before)
    allowed = first_rows(rows.where("before is null").select("day", "rid"), ["day"], ["rid"], cap).select("day", "rid", F.lit(True).alias("allowed"))
    told = rows.join(allowed, ["day", "rid"], "left")
    return told.withColumn("decision", F.coalesce("before", F.when(C("allowed"), "lookup").otherwise("capped"))).drop("before", "allowed")

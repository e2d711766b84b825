"""Upserts and state changes as joins and ranks over immutable tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key by ``order``; a map-side combinable aggregate rather than a window."""
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("row"))
    return best.select(*key, *[F.col(f"row.{c}").alias(c) for c in rest])


def upsert(base: DataFrame, delta: DataFrame, key: list[str], replace: list[str]) -> DataFrame:
    """Full outer join: ``replace`` columns come from ``delta`` where its key is present, all others from ``base``."""
    new = delta.select(*key, F.lit(True).alias("__new"), *[F.col(c).alias(f"__{c}") for c in replace])
    out = base.join(new, key, "full")
    kept = [c for c in base.columns if c not in key]
    return out.select(*key, *[F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in replace else F.col(c) for c in kept])


def gap_fill(base: DataFrame, donor: DataFrame, key: list[str], fields: list[str], label: str) -> DataFrame:
    """Fill empty ``fields`` from ``donor``; ``filled`` lists which came from it."""
    new = donor.select(*key, *[F.col(c).alias(f"__{c}") for c in fields])
    out = base.join(new, key, "left")
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    gaps = F.filter(F.array(*[F.when(empty(c) & ~(F.coalesce(F.col(f"__{c}"), F.lit("")) == ""), F.lit(f"{c}:{label}")) for c in fields]), lambda x: x.isNotNull())
    return out.withColumn("filled", gaps).select(*key, *[F.when(empty(c), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in base.columns if c not in key], "filled")

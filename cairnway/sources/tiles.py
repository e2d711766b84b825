"""Tile tables: a raster as rows (tile_y, tile_x, values array in row-major order)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tiled(cells: DataFrame, size: int, value: str = "elev_m") -> DataFrame:
    """Cells (r, c, value) to tiles; cells that are missing inside a tile are null.  A tile is bounded by its size."""
    at = (F.col("r") % size) * size + F.col("c") % size
    grouped = cells.groupBy((F.col("r") / size).cast("int").alias("tile_y"), (F.col("c") / size).cast("int").alias("tile_x")).agg(F.map_from_entries(F.collect_list(F.struct(at.alias("k"), F.coalesce(F.col(value), F.lit(float("nan"))).alias("v")))).alias("m"))
    return grouped.select("tile_y", "tile_x", F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda i: F.try_element_at("m", i)).alias("values"))


def mosaic(tiles: DataFrame, size: int, value: str = "elev_m") -> DataFrame:
    """Tiles back to the cells they were made of; no data is null."""
    out = tiles.select("tile_y", "tile_x", F.posexplode("values").alias("k", "v")).where("v is not null")
    return out.select((F.col("tile_y") * size + (F.col("k") / size).cast("int")).alias("r"), (F.col("tile_x") * size + F.col("k") % size).alias("c"), F.when(F.isnan("v"), None).otherwise(F.col("v")).alias(value))

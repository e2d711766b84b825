"""Lines to cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: A task makes so many cells.
CELLS = 500_000


def dealt_lines(lines: DataFrame, *by: str) -> DataFrame:
    """Lines in as many tasks as their cells need, those alike in ``by`` in one: few rows become many cells, and a group's are counted where they are made."""
    n = F.greatest(F.abs(F.col("r2") - F.col("r1")), F.abs(F.col("c2") - F.col("c1"))) + 1
    total = lines.agg(F.sum(n.cast("long"))).first()[0] or 0
    return lines.repartition(max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // CELLS)), *by)


def line_cells(lines: DataFrame) -> DataFrame:
    """Cells of Bresenham's line from (r1, c1) to (r2, c2), one row a cell: the longer axis advances by one, the shorter one goes along
    once the line is more than half a cell off, so that halves stay on the start's side.  Whole numbers in a JVM-side sequence, no Python."""
    dr, dc = (F.col("r2") - F.col("r1")).cast("long"), (F.col("c2") - F.col("c1")).cast("long")
    n = F.greatest(F.abs(dr), F.abs(dc))
    # What the error term of the loop has added up to after k steps: ceil(k * d / n - 1 / 2), on either side.
    steps = lambda d: (F.signum(d) * F.floor((2 * F.col("k") * F.abs(d) + n - 1) / (2 * F.greatest(n, F.lit(1))))).cast("int")
    out = lines.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), n)))
    return out.withColumn("r", F.col("r1") + steps(dr)).withColumn("c", F.col("c1") + steps(dc)).drop("k")


def access_grid(features: DataFrame) -> DataFrame:
    """(access, r1, c1, r2, c2) -> one row a touched cell with value 255 (closed) or 1 (open); closed wins, no data is skipped."""
    known = features.where("access is not null")
    return line_cells(known).groupBy("r", "c").agg(F.max(F.when(F.col("access"), 1).otherwise(255)).alias("value"))

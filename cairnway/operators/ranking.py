"""The first rows of each group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_rows(rows: DataFrame, by: list[str], order: list, n: int, name: str = "n") -> DataFrame:
    """The first ``n`` rows of each group, numbered; Spark keeps only n rows a group and task before it shuffles."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= n)

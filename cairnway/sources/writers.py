"""Writers: Parquet in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def shared_folder(spark) -> str:
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:  # tests on one machine
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="cairnway-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


#: What operators have written for themselves and for results that are read later: (folder, table or nothing).
WRITTEN: list[tuple[str, str | None]] = []


def bucketed(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Write ``rows`` as a table bucketed by ``column``: joins and groups on it read it in place, however often."""
    spark, table = rows.sparkSession, f"{name}_{uuid.uuid4().hex}"
    at = f"{shared_folder(spark)}/{table}"
    rows.write.option("path", at).bucketBy(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), column).format("parquet").saveAsTable(table)
    WRITTEN.append((at, table))
    return spark.table(table)


def release(spark, since: int = 0) -> None:
    """Delete what has been written, from the ``since``-th on; to be called once results that read it are written themselves."""
    for at, table in WRITTEN[since:]:
        if table:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        WRITTEN.remove((at, table))


def rewritten(rows: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Replace table ``name`` by ``rows`` (a folder of its own each time, so that readers of the last one go on) and read it."""
    at = f"{shared_folder(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(at)
    WRITTEN.append((at, None))
    return rows.sparkSession.read.parquet(at)

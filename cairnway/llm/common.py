"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table through Spark (any file system Spark knows)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Rows hold whole texts: few of them at once keep Python workers small.

    A DataFrame is planned when it is written, long after the call that made it, so this stays set in the session; a
    session in which the user has chosen a number keeps that.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only where it is unset and all of Spark runs on this machine (tests) a temporary folder is made and recorded in the session.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="cairnway-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


#: What operators have written for themselves: folders, and (folder, table).
WRITTEN: list[tuple[str, str | None]] = []


def stored(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts lineage: a lost executor costs a re-read, not a recomputation, and nothing lives on one machine.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(at)
    WRITTEN.append((at, None))
    return spark.read.schema(df.schema).parquet(at)


def bucketed(df: DataFrame, column: str, label: str) -> DataFrame:
    """Write ``df`` to the shared folder as a table bucketed by ``column``: joins and groups on it read it in place."""
    spark, name = df.sparkSession, f"{label}_{uuid.uuid4().hex}"
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    at = f"{shared_dir(spark)}/{name}"
    df.write.option("path", at).option("compression", "zstd").bucketBy(n, column).format("parquet").saveAsTable(name)
    WRITTEN.append((at, name))
    return spark.table(name)


def release(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Delete what operators have written, from the ``since``-th of WRITTEN on, but for folders in ``keep``.

    To be called once their results are written, as results are read from there until then.
    """
    for at, table_name in [w for w in WRITTEN[since:] if w[0] not in keep]:
        if table_name:
            spark.sql(f"DROP TABLE IF EXISTS {table_name}")
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        WRITTEN.remove((at, table_name))


def held_out(doc_id: Column, folds: int = 3) -> Column:
    """True for rows that may not be learned from: crc32 of the id as text, modulo ``folds``, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 1, F.lit(False))


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that an operator is about to add (names compared as Spark does, in any case)."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])

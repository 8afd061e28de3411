"""Working storage that every executor can reach.

Working tables lie in the folder named by ``spark.checkpoint.dir`` or, where that is not
set, in ``_working`` beside the session's warehouse tables; both are shared by all
executors. On a cluster whose warehouse is a local folder the setting must be made. They are needed until the results built on them are written, and belong to
whoever owns the folder: a cluster's own clean-up, or ``remove_working_tables`` at the
end of an application.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_PART_SHIFT = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def shared_folder(spark: SparkSession) -> str:
    """The application's folder for working tables."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        own_disk = "://" not in warehouse or warehouse.startswith("file:")
        if own_disk and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir: executors do not share the folder of the warehouse")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_working"
    return f"{folder.rstrip('/')}/{spark.sparkContext.applicationId}"


def remove_working_tables(spark: SparkSession) -> None:
    """Remove what this application has written to its working folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write once, read back: cuts the lineage and fixes the rows."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_sorted(df: DataFrame, order: list[Column], name: str, partitions: int | None = None) -> DataFrame:
    """Write ``df`` in global order and number its rows by ``part`` and ``part_row``.

    Rows are range-partitioned on the whole order, so one hot leading value is
    spread over as many partitions as it needs. Without ``partitions`` the sizes
    follow the adaptive target. The numbers are fixed by the write; reading them
    again after a lost executor gives the same ones.
    """
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    ticket = F.monotonically_increasing_id()
    numbered = ranged.sortWithinPartitions(*order).withColumn("ticket", ticket)
    return (
        stage(numbered, name)
        .withColumn("part", F.shiftright("ticket", _PART_SHIFT))
        .withColumn("part_row", F.col("ticket").bitwiseAND(F.lit((1 << _PART_SHIFT) - 1)))
        .drop("ticket")
    )

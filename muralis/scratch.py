"""Steps written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_SHARED = "file:///tmp/muralis-shared"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it's unset, the warehouse, or a local folder if the master is local."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        named = LOCAL_SHARED if re.match(r"local(\[|$)", spark.sparkContext.master) else spark.conf.get("spark.sql.warehouse.dir")
    return (named if ":" in named.split("/")[0] else f"file://{named}").rstrip("/")


_made: list[str] = []


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; removed again when the driver's Python ends."""
    path = f"{shared_dir(spark)}/muralis/{label}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_forget, spark)
    _made.append(path)
    return path


def _forget(spark: SparkSession) -> None:
    try:
        for path in _made:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone by then; the files are only scratch
        pass


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its lineage ends there."""
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

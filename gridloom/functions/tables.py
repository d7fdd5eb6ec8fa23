"""Intermediate tables in the folder that the driver and the executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..errors import InvalidParameter


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a folder of the warehouse, which on a cluster must not be a local one."""
    at = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    at = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if at.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
        raise InvalidParameter("set spark.checkpoint.dir to a folder that all executors share")
    return f"{at}/gridloom-tables"


def held(keys: DataFrame) -> DataFrame:
    """keys as the side of a shuffled join that is held in memory: the arrays on the other side pass by it, and are never sorted."""
    return keys.hint("shuffle_hash")


#: So many rows with arrays go to a Python worker at once.
ARRAY_ROWS = 256
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def written(df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
    """df as a Parquet table: computed once, and safe from lost executors. batch: so many rows go to Python at once, at most."""
    conf, path = df.sparkSession.conf, f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    before = conf.get(_BATCH)
    if batch is not None and not 0 < int(before) <= batch:
        conf.set(_BATCH, str(batch))
    try:
        df.write.parquet(path)
    finally:
        if conf.get(_BATCH) != before:
            conf.set(_BATCH, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)

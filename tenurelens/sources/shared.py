"""The cluster's shared folder for intermediate tables."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a local one only where none is set and Spark runs on this machine alone (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            folder = current.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            folder = tempfile.mkdtemp(prefix="shared-")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_WRITTEN: dict = {}


def materialize(spark: SparkSession, name: str, key: str, build) -> DataFrame:
    """A table several passes read: written once per session to the shared folder."""
    slot = (spark.sparkContext.applicationId, name, key)
    if slot not in _WRITTEN:
        path = new_path(spark, name)
        build().write.parquet(path)
        _WRITTEN[slot] = path
    return spark.read.parquet(_WRITTEN[slot])

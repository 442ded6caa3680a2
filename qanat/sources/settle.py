"""Set a frame down once when several consumers follow, so that a lost executor costs one read and not the
whole lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DIR_SETTING = "spark.checkpoint.dir"
_own_folders: dict[str, str] = {}  # per application, only where the cluster names none


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints, by setting or on its context. Without one only a session whose
    executors run inside the driver gets a fresh local folder; any other raises."""
    named = spark.conf.get(DIR_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"{DIR_SETTING} must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        named = _own_folders.setdefault(app, "") or tempfile.mkdtemp(prefix="qanat-")
        _own_folders[app] = named
    return named.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: consumers prune columns and know its size."""
    path = f"{shared_folder(df.sparkSession)}/qanat-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

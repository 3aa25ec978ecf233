"""Folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: The local folder of an application that names none.
_OWN: dict[str, str] = {}


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir. Only a session on one machine may name none; it gets a local folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = _OWN.setdefault(spark.sparkContext.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="seqlab-shared-")
        _OWN[spark.sparkContext.applicationId] = root
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: a short lineage that outlives executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

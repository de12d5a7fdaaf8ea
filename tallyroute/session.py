"""The shared folder of a session."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SHARED_FOLDER = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only where it is unset in local mode (tests) a folder beside the session's
    warehouse takes its place and is remembered; on a cluster it must be set.
    """
    folder = spark.conf.get(SHARED_FOLDER, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {SHARED_FOLDER} to a folder all executors can reach")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tallyroute-shared"
        spark.conf.set(SHARED_FOLDER, folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/tallyroute/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its rows are fixed, its lineage is cut."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

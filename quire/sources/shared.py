"""The folder that the driver and all executors share."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; it becomes the checkpoint folder if there is none yet.

    Where the setting is missing, a local session (one machine, as in tests) gets a folder of that machine; a cluster is
    refused, as its machines share no folder that could be guessed.
    """
    folder = spark.conf.get(SETTING, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{SETTING} must name a folder that all machines share")
        folder = "file:///tmp/checkpoints/quire"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder

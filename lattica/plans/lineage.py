"""Cutting a plan's lineage between rounds of an iteration, in the folder that all machines share."""

from __future__ import annotations

import tempfile

from pyspark import SparkContext
from pyspark.sql import DataFrame


def shared_folder(context: SparkContext) -> str:
    """The folder of spark.checkpoint.dir. Where the session names none, a local one will do in local mode; on a cluster it would not."""
    folder = context.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.gettempdir()
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The rows as a checkpoint, with no lineage behind them."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(f"{shared_folder(context)}/lattica-checkpoints")
    return df.checkpoint(eager=True)

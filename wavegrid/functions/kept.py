"""Tables that are computed once and kept where all executors find them."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a temporary one only where the session names none and runs in one process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="wavegrid-"))
    return sc.getCheckpointDir()


def kept(rows: DataFrame) -> DataFrame:
    """rows as a checkpoint in the shared folder: computed at once, and found again by whatever executors there are.

    Spark deletes it with the session's last use of it where spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    shared_folder(rows.sparkSession)
    return rows.checkpoint()

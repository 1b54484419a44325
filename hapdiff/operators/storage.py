"""Results that several later steps read, kept in the cluster's shared folder."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. A temporary one only in local mode, where no other machine has to see it."""
    context = spark.sparkContext
    found, current = context.getConf().get("spark.checkpoint.dir", None), context.getCheckpointDir()
    if found is None and current is not None:
        found = current.rsplit("/", 1)[0]  # Spark puts a folder of its own name into the one that was set
    if found is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="hapdiff-checkpoints-")
        context.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and written to the checkpoint folder: later plans begin there, and a lost executor costs no recomputation.

    Spark deletes the files when nothing refers to them any more if spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of any store that Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Keep]:
    """A folder within the checkpoint folder that holds all that is cut here; it is deleted at the end, also after an error.

    What is to stay is handed to the Keep that this gives, which cuts it to the folder outside. Checkpoints go to one folder a
    session at a time, so two analyses of one session should not overlap.
    """
    outer = checkpoint_folder(spark)
    own = f"{outer}/run-{uuid.uuid4().hex}"
    spark.sparkContext.setCheckpointDir(own)
    try:
        yield Keep(spark, outer, own)
    finally:
        spark.sparkContext.setCheckpointDir(outer)
        remove(spark, own)


class Keep:
    """Cuts what outlives a scratch folder."""

    def __init__(self, spark: SparkSession, outer: str, own: str):
        self.spark, self.outer, self.own = spark, outer, own

    def __call__(self, df: DataFrame) -> DataFrame:
        self.spark.sparkContext.setCheckpointDir(self.outer)
        try:
            return cut(df)
        finally:
            self.spark.sparkContext.setCheckpointDir(self.own)

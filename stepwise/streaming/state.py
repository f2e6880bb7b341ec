"""The folder that all machines share, and what is kept there: cut lineages and written states."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..errors import ProgressiveError


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Where that is unset, as in tests, a temporary folder serves; a cluster, whose machines would each
    have another one, must name its own.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not named and not context.master.startswith("local"):
            raise ProgressiveError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="stepwise-"))
    return named or context.getCheckpointDir()


def new_folder(spark: SparkSession, kind: str) -> str:
    """The name of a new folder in the shared one."""
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def discard(spark: SparkSession, folder: str) -> None:
    """Delete a folder that nothing reads any more; one that is gone doesn't matter."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

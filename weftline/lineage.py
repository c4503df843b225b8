"""Cutting lineage into the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: what ``spark.checkpoint.dir`` names. A local session that names none gets a temporary one, removed at exit; a cluster must name one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so that a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    For loops: a checkpoint keeps the estimated size of its plan, which joins multiply round by round without end; a file has its own.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def removed(df: DataFrame) -> None:
    """Delete the files that a table made by ``written`` is read from; nothing may read it any more."""
    folder = shared_folder(df.sparkSession).rstrip("/")
    hadoop = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = hadoop.Path(file)
        if path.getParent().toUri().getPath().rstrip("/") == hadoop.Path(folder).toUri().getPath().rstrip("/"):
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import threading
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

#: Tables that this process wrote and has not released, oldest first: path, the JVM's path and settings, the thread.
_WRITTEN: dict[str, tuple] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none and runs in one process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="prefixloom-"))
    return sc.getCheckpointDir()


def materialised(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: the lineage ends there, and a lost executor costs no recomputation.

    Against ``checkpoint()`` this is columnar, compressed and has a size that the optimizer sees. The table
    stays until it is released or the process ends, since results that are read later may need it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN[path] = spark._jvm.org.apache.hadoop.fs.Path(path), spark.sparkContext._jsc.hadoopConfiguration(), threading.get_ident()
    return spark.read.schema(df.schema).parquet(path)


def tables() -> list[str]:
    """The tables that this thread wrote and that are there, oldest first; another thread's query may still read its own."""
    return [path for path, (_, _, thread) in _WRITTEN.items() if thread == threading.get_ident()]


def release(paths: Iterable[str] | None = None) -> None:
    """Deletes tables of ``materialised``, or all of them; nothing that reads them may be run afterwards."""
    for path in list(_WRITTEN if paths is None else paths):
        if path in _WRITTEN:
            target, settings, _ = _WRITTEN.pop(path)
            target.getFileSystem(settings).delete(target, True)


@atexit.register
def _at_exit() -> None:
    try:
        release()
    except Exception:  # the JVM may be gone already; the tables are in the application's own folder
        _WRITTEN.clear()

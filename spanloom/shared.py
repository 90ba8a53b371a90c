"""The folder that the driver and all executors share, for what is written once and read again."""

from __future__ import annotations

import atexit
import os
import posixpath
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders that this driver made and hasn't deleted.
_made: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Without the setting a local one of our own, in local mode alone; a cluster raises."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        held = sc._jsc.sc().getCheckpointDir()
        if held.isDefined():
            path = held.get()
        elif sc.master == "local" or sc.master.startswith("local["):
            path = tempfile.mkdtemp(prefix="spanloom-")
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. What is put there lasts until ``discard`` or the end of the driver."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """``df`` as a Parquet table in the shared folder, for results that several jobs read. Its columns are numbered there: names may differ in case alone."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    plain = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    plain.write.option("compression", codec).parquet(path)
    out = spark.read.schema(plain.schema).parquet(path).toDF(*df.columns)
    out._scratch = path
    return out


def discard(*frames: DataFrame | str) -> None:
    """Deletes what ``written`` made, once nothing that is still to be computed reads it."""
    for frame in frames:
        path = frame if isinstance(frame, str) else getattr(frame, "_scratch", None)
        spark = _made.pop(path, None)
        if spark is not None:
            there = spark._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def put_text(uri: str, text: str) -> None:
    """A file of its own under a URI or path, whole or not at all; from tasks."""
    from pyarrow import fs

    if "://" in uri:
        system, path = fs.FileSystem.from_uri(uri)
    else:
        system, path = fs.LocalFileSystem(), os.path.abspath(uri.removeprefix("file:"))
    system.create_dir(posixpath.dirname(path), recursive=True)
    passing = f"{posixpath.dirname(path)}/.{uuid.uuid4().hex}.part"
    with system.open_output_stream(passing, compression=None) as out:
        out.write(text.encode())
    system.move(passing, path)


@atexit.register
def _discard_all() -> None:
    for path in list(_made):
        try:
            discard(path)
        except Exception:  # the session is gone: what can't be reached any more stays
            return

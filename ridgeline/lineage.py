"""Cutting lineage where a table is read many times."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame


def _folder(df: DataFrame) -> str:
    session, context = df.sparkSession, df.sparkSession.sparkContext
    base = session.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="ridgeline-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    session.conf.set("spark.checkpoint.dir", f"file://{folder}")
    return f"file://{folder}"


def settled(df: DataFrame) -> DataFrame:
    """df written as Parquet to the folder that all executors share (spark.checkpoint.dir) and read again, so that plans above it start there.

    In local mode, where the setting is missing, a folder of our own is used."""
    path = f"{_folder(df)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled_path = path
    return out


def shared_path(df: DataFrame, name: str) -> str:
    """A path that isn't used yet in the folder that all executors share."""
    return f"{_folder(df)}/{name}-{uuid.uuid4().hex}"


def forget(*frames: DataFrame) -> None:
    """Delete the files behind settled frames that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_settled_path", None)
        if path:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)

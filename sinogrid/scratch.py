"""Folders for intermediate tables that outlive the loss of an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The shared folder named by the session; a temporary one only in local mode."""
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_DIR, None) or context.getConf().get(CHECKPOINT_DIR)
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all nodes share")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="sinogrid-")
    return _local_folders[context.applicationId]


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    files, where = _filesystem(spark, path)
    return files.exists(where)


def committed(spark: SparkSession, path: str) -> bool:
    """True when a job has finished writing `path`."""
    return exists(spark, f"{path}/_SUCCESS")


def numbers(spark: SparkSession, path: str, name: str) -> list[int]:
    """The n of all folders path/name=n that a job has finished writing."""
    files, where = _filesystem(spark, f"{path}/{name}=*")
    found = [str(f.getPath().getName()).split("=")[1] for f in files.globStatus(where) or []]
    return sorted(int(n) for n in found if committed(spark, f"{path}/{name}={n}"))


def discard(spark: SparkSession, path: str) -> None:
    """Remove an intermediate table of this run."""
    files, where = _filesystem(spark, path)
    if files.exists(where):
        files.delete(where, True)

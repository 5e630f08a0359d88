"""Intermediate tables that survive the loss of an executor."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


_OWN: ContextVar[list[str] | None] = ContextVar("own", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Where it is unset a session in one process gets a folder of its own; a cluster
    must name one, because a machine-local folder is lost with its machine.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder:
        return folder
    if sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="goldrec-"))
    return sc.getCheckpointDir()


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for a job's own tables."""
    return f"{shared_dir(spark)}/goldrec/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` computed once and read back from a table in the shared folder.

    Readers get column pruning and a known size, and a lost executor costs a
    re-read, not the lineage.
    """
    path = work_path(df.sparkSession, name)
    own = _OWN.get()
    if own is not None:
        own.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``durable`` writes inside are deleted at the end, so that a stream
    leaves none behind; what is read from them must be written by then."""
    token = _OWN.set([])
    try:
        yield
    finally:
        paths = _OWN.get() or []
        _OWN.reset(token)
        sc = spark.sparkContext
        hadoop, conf = sc._jvm.org.apache.hadoop.fs, sc._jsc.hadoopConfiguration()
        for path in map(hadoop.Path, paths):
            path.getFileSystem(conf).delete(path, True)

"""Intermediate tables in the folder that every executor shares.

Writing a table cuts the lineage: a lost executor costs the tasks that it ran,
not the stages before the table. The folder is `spark.checkpoint.dir`; a
temporary one is made only in local mode, where one machine runs everything, and
goes with the process.

An operator works inside `temporary`: at its end the tables that its result does
not read are deleted. Those that it does read go when the block around the
operator ends, if there is one; otherwise they stay for as long as the caller
may read the result, and `clean` removes them.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
#: The tables of the innermost block: path, read by the result or not. Every thread has its own.
_block: ContextVar[list[tuple[str, bool]] | None] = ContextVar("block", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder; raises on a cluster that names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local[") and spark.conf.get("spark.master", "local") != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.conf.get("spark.app.id", "app")
    if app not in _local:
        made = tempfile.mkdtemp(prefix="millrace-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        _local[app] = "file://" + made
    return _local[app]


def store(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Writes `df` as Parquet in the shared folder and returns the table read back.

    `keep` is for tables that the operator's result reads.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    block = _block.get()
    if block is not None:
        block.append((path, keep))
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """A block of stored tables; those without `keep` are deleted at its end, the others belong to the block around it."""
    own: list[tuple[str, bool]] = []
    before = _block.set(own)
    try:
        yield
    finally:
        _block.reset(before)
        outer = _block.get()
        for path, keep in own:
            if not keep:
                _delete(spark, path)
            elif outer is not None:
                outer.append((path, False))


def clean(spark: SparkSession) -> None:
    """Deletes all stored tables in the session's shared folder; nothing may read them afterwards."""
    _delete(spark, f"{shared_dir(spark)}/millrace")


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

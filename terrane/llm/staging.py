"""Intermediate tables written to the folder that the driver and all executors share.

A written table cuts the lineage, survives the loss of any executor and is read column by column. The folder is the one
named by spark.checkpoint.dir; only a local session without that setting (a test) gets a folder of its own, as a cluster's
executors would not see it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """URI of the folder for intermediate data of this application."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if not found:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="terrane-"))
        found = sc.getCheckpointDir()
    return found


_SCOPES: list[list[Staged]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Drops, at the end, the tables written inside, but for those that keep() hands on to the scope around."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for x in _SCOPES.pop():
            x.drop()


class Staged:
    """A table written once; drop() removes its files when nothing reads them any more."""

    def __init__(self, df: DataFrame, label: str):
        self.spark = df.sparkSession
        self.path = f"{shared_folder(self.spark)}/{label}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        self.dropped = False
        if _SCOPES:
            _SCOPES[-1].append(self)

    def keep(self) -> Staged:
        """The table outlives the innermost scope."""
        if _SCOPES and self in _SCOPES[-1]:
            _SCOPES[-1].remove(self)
            if len(_SCOPES) > 1:
                _SCOPES[-2].append(self)
        return self

    def drop(self) -> None:
        if self.dropped:
            return
        self.dropped = True
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, label: str) -> DataFrame:
    """df, written and read again."""
    return Staged(df, label).df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

"""Intermediate tables in the shared checkpoint folder.

Written tables survive the loss of executors and cut the lineage of iterative jobs.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


# Temporary folders of local sessions without a checkpoint folder, by application.
_LOCAL_ROOTS: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a local session without one gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    if context.applicationId not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[context.applicationId] = tempfile.mkdtemp(prefix="duowave-")
    return _LOCAL_ROOTS[context.applicationId]


class Scratch:
    """A private sub-folder of the checkpoint folder holding named Parquet tables."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{checkpoint_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
        """Write ``df`` under ``name`` (replacing an earlier table of that name) and read it back."""
        target = f"{self.path}/{name}"
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(target)
        return self.spark.read.schema(df.schema).parquet(target)

    def remove(self) -> bool:
        """Delete all tables written here; their DataFrames cannot be read afterwards."""
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        return folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Compute ``df`` once and return a DataFrame over the written result."""
    return Scratch(df.sparkSession, label).write(df, "data")

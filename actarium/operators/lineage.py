"""Cutting the lineage of iterative work."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Only a local session may go without that setting: it then gets a
    folder of its own for as long as it lives. On a cluster a machine-local folder would lose what other machines wrote."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="checkpoint-")
    return _OWN[app]


def cut(df: DataFrame) -> DataFrame:
    """The rows as a table written in the shared folder. Unlike a checkpoint, a table forgets the constraints of the plan
    it comes from, which otherwise grow in every round of a loop."""
    at = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)

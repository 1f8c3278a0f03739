"""Written intermediate tables in the folder that all executors share, and the common view of the documents table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import shared_folder

#: Rank of a null id: before all others.
NULL_RANK = -(1 << 63)


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Spark's setting by which a query's shuffle files go when it ends.
_SHUFFLES_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, shuffles_end: bool = False) -> DataFrame:
    """The rows as a table in the shared folder: cuts the lineage and is computed once, also if an executor is lost.

    shuffles_end: the shuffle files of this write, which nothing reads again, go with its end and not when the driver happens
    to collect its garbage."""
    at, conf = folder(df.sparkSession, name), df.sparkSession.conf
    kept = conf.get(_SHUFFLES_END, None)
    if shuffles_end:
        conf.set(_SHUFFLES_END, "true")
    try:
        df.write.parquet(at)
    finally:
        if shuffles_end:
            conf.unset(_SHUFFLES_END) if kept is None else conf.set(_SHUFFLES_END, kept)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def small_batches(df: DataFrame) -> DataFrame:
    """Arrow batches of a few MB, so that a task's memory does not follow the length of the texts. Bounds the session's
    setting only where that is larger."""
    conf, most = df.sparkSession.conf, 4 << 20
    kept = conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    if not kept or not kept.isdigit() or not 0 < int(kept) <= most:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))
    return df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ranked(docs: DataFrame) -> DataFrame:
    """doc_id, rank (its order; null before all others), mark (a hash of the text, so that rows which share an id but
    not a text stay apart) and text (null: empty). Every other column is left out, whatever its name."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_RANK)).alias("rank"),
        F.xxhash64("text").alias("mark"), F.coalesce("text", F.lit("")).alias("text"))

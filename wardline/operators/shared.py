"""Intermediate results that several parts of a plan read, kept in the folder that the cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; one of our own only in a local session where spark.checkpoint.dir is unset."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="wardline-"))
    return context.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """df, worked out once into the shared folder, without its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df over all cores, by keys if any, before costly work: a table of few row groups is else read and worked on by few tasks."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)

"""Reading of tables and cutting of lineage."""

from __future__ import annotations

import gc
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

from faktum.llm import textkit


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the folder that the cluster shares (spark.checkpoint.dir) and goes on from there.

    Without that setting a folder of this machine is taken if Spark runs on this machine alone, as in tests; on a
    cluster, where parts would land on different machines, that is an error.
    """
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.match(r"local(\[|\Z)", context.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the cluster shares")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="faktum-"))
    out = df.checkpoint(eager=True)
    release(df.sparkSession)
    return out


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of work that is done; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    textkit.trim()
    spark.sparkContext._jvm.System.gc()

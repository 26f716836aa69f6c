"""Tables between the steps of a job, in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`; where all runs on one machine and none is set, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), f"profseg-steps-{os.getpid()}")
    return base.rstrip("/")


#: Spark's setting that the shuffle files of a query go when it ends: nobody reads them once its table is written.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(df: DataFrame) -> DataFrame:
    """`df` written as Parquet and read back: its lineage ends there, and a lost executor costs a reread."""
    spark = df.sparkSession
    path = f"{folder(spark)}/step-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete tables that settled() wrote and that no later plan reads."""
    for df in tables:
        context = df.sparkSession.sparkContext
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if path.rsplit("/", 1)[1].startswith("step-"):
                target = context._jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)

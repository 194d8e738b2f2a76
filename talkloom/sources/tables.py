"""Reading the project's tables, and intermediate tables in shared storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table `name` of `folder` (a file or a directory of part files)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its input has fewer pieces than there are; large inputs pass as they are.

    For costly expressions over small files, whose few row groups would keep most cores
    idle. A df that is shuffled already is left to adaptive execution.
    """
    cores, run = df.sparkSession.sparkContext.defaultParallelism, df._jdf.queryExecution()
    plan = run.executedPlan()
    shuffled = plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" or plan.outputPartitioning().getClass().getSimpleName() not in ("UnknownPartitioning", "SinglePartition$")
    if shuffled:
        return df
    return df.repartition(cores) if run.toRdd().getNumPartitions() < cores else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one where that is unset and all run on one machine (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        folder = "file://" + tempfile.mkdtemp(prefix="talkloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stage(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """df written to the shared folder and read again.

    Cuts the lineage and computes df once, and outlives the loss of executors, as
    the files are in storage that all of them share.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/talkloom-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._talkloom_path = path
    return out


def drop_stage(df: DataFrame) -> None:
    """Deletes what stage() wrote, once nothing reads it any more."""
    path = getattr(df, "_talkloom_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)

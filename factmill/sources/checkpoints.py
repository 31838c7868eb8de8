"""Cutting lineage with tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of our own only where that is unset and Spark runs in one process."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="factmill-"))
    return context.getCheckpointDir()


def cut(df: DataFrame, **options: str) -> DataFrame:
    """df computed once and read back: its rows are in the shared folder, with no lineage behind them.

    options are those of Spark's Parquet writer, such as compression. A written table, since in loops the copies that checkpoint() returns keep column
    properties under identities they no longer have, on which unions of them fail.
    """
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def cut_observed(df: DataFrame, *metrics: Column) -> tuple[DataFrame, dict]:
    """cut(df), and named aggregates over its rows, from the job that writes them."""
    seen = Observation()
    out = cut(df.observe(seen, *metrics))
    return out, seen.get


def cut_counted(df: DataFrame, condition: str = "true") -> tuple[DataFrame, int]:
    """cut(df), and how many of its rows meet the condition."""
    out, seen = cut_observed(df, F.count(F.when(F.expr(condition), 1)).alias("n"))
    return out, seen["n"]


def cut_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both sides' rows, cut, in as many files as a shuffle has partitions at most."""
    return cut(a.union(b).coalesce(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def release(*tables: DataFrame) -> None:
    """Deletes cut tables that nothing will read again, as loops do with the rounds before."""
    for t in tables:
        if (path := getattr(t, "_cut_path", None)) is not None:
            jvm = t.sparkSession._jvm
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)

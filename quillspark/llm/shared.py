"""Helpers that the training-data operators share: the shared folder, staged tables, input guards."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a local one only where that is unset in local mode (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


#: Paths of staged tables that are still there, oldest first.
STAGED: list[str] = []


def staged(df: DataFrame, label: str) -> DataFrame:
    """df written once as a table in the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    STAGED.append(path)
    return out


def unstage(df: DataFrame) -> None:
    """Deletes a staged table that nothing reads any more."""
    path = getattr(df, "staged_path", None)
    if path:
        _delete(df.sparkSession, path)


def release(spark: SparkSession, keep: DataFrame, known: int = 0) -> None:
    """Deletes the tables staged after the first ``known``, but for the one to keep."""
    for path in [p for p in STAGED[known:] if p != getattr(keep, "staged_path", None)]:
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    if path in STAGED:
        STAGED.remove(path)


#: Rows of an Arrow batch. Texts are long: with Spark's 10000 a batch and its copies fill a worker's memory.
BATCH = 2000


def mapped(df: DataFrame, run: Callable, schema: T.StructType | str) -> DataFrame:
    """df.mapInArrow in batches of at most BATCH rows, so that a worker's memory is bounded."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, BATCH + 1):
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    return df.mapInArrow(run, schema)


def column(df: DataFrame, name: str, kind: str) -> Column:
    """The named column cast to a type, or nulls of that type where the table has none."""
    return (F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name)


def rows_of(df: DataFrame, **kinds: str) -> DataFrame:
    """Only the columns that an operator reads, so that further columns never clash with its own."""
    return df.select(*(column(df, name, kind) for name, kind in kinds.items()))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table, dealt over all cores where its files can't be split that far (few row groups); one of more splits stays as it is."""
    df, cores = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.sparkContext.defaultParallelism
    return df if df._jdf.rdd().getNumPartitions() >= cores else df.repartition(cores)


def struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])

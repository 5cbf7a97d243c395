"""Sources and sinks: line JSON, CSV with quoted line ends, JSON documents, model artifacts, literal corpora."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a local one only where that is unset in local mode (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not named:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


#: Staged tables of this process, deleted when it ends: a result that is still to be computed may read them until then.
STAGED: list[tuple] = []


def stage(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not STAGED:
        atexit.register(release)
    STAGED.append((spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path))
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Deletes all staged tables, if the JVM that wrote them is still there."""
    for jvm, conf, path in STAGED:
        try:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
        except (Py4JError, OSError):
            break
    STAGED.clear()


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores where its files can't be split that far (a few row groups): each text costs far more to measure than to move.

    A table of as many splits as cores stays as it is, so that nothing is shuffled at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.rdd().getNumPartitions() >= cores else df.repartition(cores)


CORPUS = "essay_id string, group_id string, label string, text string, topic_category string, model_family string, generation_prompt string, esl_metadata string, provenance struct<source_dataset:string,license:string,is_synthetic:boolean>, word_count bigint, text_hash string, binary_label int"


def read_corpus(spark: SparkSession, path: str, schema: str = CORPUS) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).options(header=True, multiLine=True, escape='"').csv(path)


def write_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(header=True, escape='"').csv(path)


def write_document(df: DataFrame, path: str) -> None:
    """One JSON document for each row."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


class UnsoundTable(ValueError):
    """A table with nulls, NaN or infinities where numbers must stand; what was written of it is gone."""


def write_checked(df: DataFrame, path: str, columns: list[str]) -> dict[str, int]:
    """Writes Parquet and counts, in the same pass, rows and the nulls, NaN and infinite values of the columns.

    Where any is found the folder, which must not be there before, is deleted and the write fails.
    """
    seen = Observation()
    count = lambda f: sum((F.count_if(f(F.col(c).cast("double"))) for c in columns), F.lit(0)).cast("long")
    found = {"nulls": count(lambda c: c.isNull()), "nans": count(F.isnan), "infinite": count(lambda c: F.abs(c) == float("inf"))}
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(n) for n, c in found.items())).write.mode("error").parquet(path)
    got = {k: int(v or 0) for k, v in seen.get.items()}
    if any(got[k] for k in found):
        delete(df.sparkSession, path)
        raise UnsoundTable(f"{path}: {got}")
    return got


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


ARTIFACT = "version string, weights array<struct<feature:string,coefficient:double,mean:double,scale:double>>, intercept double, thresholds array<double>, reference array<struct<feature:string,mean:double,std:double,median:double,p10:double,p90:double>>, baseline struct<mean:array<double>,std:array<double>,inverse:array<array<double>>>"


def save_artifact(spark: SparkSession, path: str, weights: dict, intercept: float, thresholds=(0.35, 0.65, 0.85), version: str = "1", reference: dict | None = None, baseline: dict | None = None) -> None:
    """A scoring model as a one-row table: weights, thresholds, human reference (mean, deviation, median and tails by feature) and baseline."""
    base = baseline and tuple(baseline[k].tolist() for k in ("mean", "std", "inverse"))
    told = [(k, *(None if x is None else float(x) for x in (*v, None, None, None)[:5])) for k, v in (reference or {}).items()]
    row = (version, [(k, *map(float, v)) for k, v in weights.items()], float(intercept), list(map(float, thresholds)), told, base)
    spark.createDataFrame([row], ARTIFACT).write.mode("overwrite").json(path)


def load_artifact(spark: SparkSession, path: str) -> dict:
    """version, weights, intercept, thresholds, reference and baseline as they were saved."""
    row = spark.read.schema(ARTIFACT).json(path).first()
    base = row.baseline and {k: np.array(row.baseline[k]) for k in ("mean", "std", "inverse")}
    reference = {r.feature: (r["mean"], r.std, *((r.median, r.p10, r.p90) if r.median is not None else ())) for r in row.reference or ()}
    return {"version": row.version, "weights": {w.feature: (w.coefficient, w.mean, w.scale) for w in row.weights}, "intercept": row.intercept, "thresholds": list(row.thresholds or (0.35, 0.65, 0.85)), "reference": reference, "baseline": base}


# ---- models as a table of versions

MODEL = "feature string, coefficient double, mean double, scale double, reference double"
#: The row that holds the intercept as its coefficient.
INTERCEPT = "(intercept)"


def add_version(spark: SparkSession, path: str, version: int, weights: dict, intercept: float, reference: dict[str, float] | None = None) -> None:
    """A version more of a model: a row for each feature, in a folder of its own, so that readers see it whole or not at all."""
    rows = [(k, *map(float, v), float((reference or {}).get(k, 0.0))) for k, v in weights.items()] + [(INTERCEPT, float(intercept), 0.0, 1.0, 0.0)]
    spark.createDataFrame(rows, MODEL).coalesce(1).write.mode("error").parquet(f"{path}/version={int(version)}")


def newest_version(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the greatest version, with it: read anew at each call. Folders that a write hasn't finished don't count."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in store.listStatus(where)] if store.exists(where) else []
    done = [int(n.removeprefix("version=")) for n in names if n.startswith("version=") and store.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    if not done:
        raise FileNotFoundError(f"no version of a model in {path}")
    return spark.read.schema(MODEL).parquet(f"{path}/version={max(done)}").withColumn("version", F.lit(max(done)))


#: What ids of records begin with, by label; others begin with the label.
ID_PREFIX = {"synthetic_polished": "polished"}


def as_records(df: DataFrame) -> DataFrame:
    """Adds essay_id (label and eight digits of the text's MD5) and binary_label (0: human, also where there is no label)."""
    label = F.coalesce("label", F.lit("human"))
    prefix = label
    for kind, name in ID_PREFIX.items():
        prefix = F.when(label == kind, name).otherwise(prefix)
    return df.withColumns({"essay_id": F.concat(prefix, F.lit("_"), F.substring(F.md5("text"), 1, 8)), "binary_label": F.when(label == "human", 0).otherwise(1)})


def literal_corpus(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    """label, group_id and text as records."""
    return as_records(spark.createDataFrame(rows, "label string, group_id string, text string"))


def with_prompt(df: DataFrame, prompts: dict[str, str], default: str) -> DataFrame:
    """generation_prompt by the second part of group_id, else the default."""
    table = df.sparkSession.createDataFrame(list(prompts.items()) or [(None, None)], "_key string, generation_prompt string")
    return df.withColumn("_key", F.split_part("group_id", F.lit("_"), F.lit(2))).join(table, "_key", "left").drop("_key").withColumn("generation_prompt", F.coalesce("generation_prompt", F.lit(default)))

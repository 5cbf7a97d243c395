"""The stateless analysis over a stream: the same plan as for a table, by a model that may be replaced while the stream runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import documents, model
from ..sources import files


def scored(spark: SparkSession, path: str, schema, weights: dict, intercept: float) -> DataFrame:
    """doc_id, probability, verdict of documents as they arrive in a folder of Parquet files."""
    stream = spark.readStream.schema(schema).parquet(path)
    gated = documents.gate(stream).withColumn("text", F.col("cleaned"))
    out = documents.undecided(model.score(documents.features(gated), weights, intercept))
    return documents.verdict(out).select("doc_id", "word_count", "probability", "verdict", "confidence")


def score_by_versions(stream: DataFrame, models: str, columns: list[str], out: str, checkpoint: str, measure: Callable[[DataFrame], DataFrame] = documents.features) -> StreamingQuery:
    """Scores doc_id and text as they arrive, each micro-batch by the newest version of the model's table at its beginning.

    ``measure`` adds the columns that the model asks for to rows with text.
    Writes doc_id, version, probability and verdict to ``out``/batch=n: a batch that is run again after a failure, if by
    a newer version, replaces what it wrote.
    """

    def each(batch: DataFrame, number: int) -> None:
        table = files.newest_version(batch.sparkSession, models)
        gated = documents.gate(batch).withColumn("text", F.col("cleaned"))
        judged = documents.verdict(documents.undecided(model.score_by_table(measure(gated), columns, table)))
        judged.select("doc_id", "version", "probability", "verdict").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

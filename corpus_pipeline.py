"""A corpus from raw documents: language, near copies, benchmark leaks, personal data, then token ids.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm import decontaminate, langid, pieces, pii, simhash
from quillspark.llm.shared import STAGED, documents, mapped, release, staged

#: From so many bits a byte on, a text is in none of the learned languages: raw bytes would be as short.
RAW_BITS = 8.0


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of no language: null texts, texts without a letter, and those that no language shortens."""
    model = langid.fit(docs)
    if model is None:  # nothing is learned: only texts without a letter can be rejected
        return docs.where(F.col("text").rlike(r"\p{L}"))
    shipped = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                batch = whole.slice(lo, 1024)
                texts = [t.encode("utf-8", "replace") for t in batch.column("text").to_pylist()]
                bits = langid.code_lengths(shipped.value, texts).min(axis=1)
                yield batch.filter(pa.array([b < RAW_BITS * len(t) for b, t in zip(bits.tolist(), texts)], pa.bool_()))

    return mapped(docs.where(F.col("text").rlike(r"\p{L}")), run, docs.schema)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least doc_id in each group (of rows that share it, the first by text). Rows without a doc_id stay."""
    kept = simhash.near_duplicates(docs).where("doc_id = component_id").select("doc_id").distinct()
    own = docs.join(kept, "doc_id").withColumn("_row", F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).where("_row = 1")
    return own.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a benchmark item is found. Rows without a doc_id stay."""
    leaks = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(leaks.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts pseudonyms for personal data; n_chars follows the text."""
    out = pii.pseudonymise(docs, pii.key_of(spark))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each document: doc_id, its number of pieces and their digest, scores, and whether decoding gives the text."""
    return pieces.digest(pieces.encode(docs))


STAGES = [("language ID", language), ("SimHash near-dedup", near_duplicates), ("benchmark decontamination", decontaminated), ("PII", personal_data), ("SentencePiece", token_ids)]

#: SQL can't express the language, SimHash, retrieval and segmentation stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    known = len(STAGED)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.split()[0])
        release(spark, docs, known)  # what the stage wrote on its way, and its input
    return STAGES[-1][1](spark, docs, sf_dir)

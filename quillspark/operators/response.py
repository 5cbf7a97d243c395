"""The whole analysis of a document in one nested row: gate, measurements, score, verdict, contributions, spans, disclaimers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import files
from . import documents, model

VERSION = "1"
#: All 48 measurements in order.
COLUMNS = [*documents.BASE, *documents.DISTANCES]


def with_distances(df: DataFrame, base: dict | None, paragraphs_of: str = "text") -> DataFrame:
    """The four distances of rows with the base measurements and text; dispersion is that of a text's paragraphs. (0, 0, 1, 0) without a baseline."""
    if base is None:
        return df.withColumns(dict(zip(documents.DISTANCES, map(F.lit, (0.0, 0.0, 1.0, 0.0)))))
    out = model.distances(df, list(documents.BASE), base).withColumnsRenamed({f"dist_{k}": f"dist_human_{k}" for k in ("euclidean", "mahalanobis", "cosine")})
    many = df.select("doc_id", F.col(paragraphs_of).alias("text")).where(F.col("text").rlike(r"\n\n"))  # one paragraph has no dispersion
    spread = model.dispersion(documents.features(documents.paragraph_spans(many)), list(documents.BASE))
    return out.join(spread, "doc_id", "left").fillna(0.0, ["dist_structural_dispersion"])


def measured(rows: DataFrame, carry: list[str]) -> tuple[DataFrame, dict]:
    """The 48 measurements of the cleaned texts of rows (doc_id, text, label), staged, and the baseline of label 0."""
    # Staged, so that the cleaning isn't written out anew in each of the measurements that read its text.
    cleaned = files.stage(documents.clean(rows).select("doc_id", *carry, "label", F.col("cleaned").alias("text")))
    base44 = files.stage(documents.features(cleaned))
    base = model.fit_baseline(base44.where("label = 0"), list(documents.BASE))
    return files.stage(with_distances(base44, base)), base


def train(essays: DataFrame, base: dict, version: str = VERSION) -> dict:
    """What analyse() needs: weights and intercept fitted on the measured rows, the human reference (mean, deviation, median, p10, p90) and the baseline."""
    weights, intercept = model.fit_logistic(essays, COLUMNS)
    told = model.quantiles(essays.where("label = 0"), COLUMNS).collect()  # 48 rows
    return {"version": version, "weights": weights, "intercept": intercept, "reference": {r.feature: (r["mean"], r.std, r.median, r.p10, r.p90) for r in told}, "baseline": base}


def train_and_export(rows: DataFrame, path: str, version: str = VERSION) -> dict:
    """Measures labelled rows, trains, and writes the artifact to path; files.load_artifact gives it again."""
    artifact = train(*measured(rows, []), version)
    files.save_artifact(rows.sparkSession, path, artifact["weights"], artifact["intercept"], version=version, reference=artifact["reference"], baseline=artifact["baseline"])
    return artifact


def analyse(df: DataFrame, artifact: dict) -> DataFrame:
    """The response of every row of doc_id and text by a trained artifact."""
    human = {c: v[0] for c, v in artifact["reference"].items()}
    ready = files.stage(gated(df.select("doc_id", "text")))
    return respond(ready, lambda rows: with_distances(documents.features(rows), artifact["baseline"], "raw"), artifact["weights"], artifact["intercept"], human, version=artifact["version"])


def _drivers(weights: dict[str, tuple[float, float, float]], reference: dict[str, float]) -> Column:
    """Array of struct(feature, observed_value, reference_mean, impact_score, direction), largest impact first."""
    impact = lambda c, w: F.round(F.greatest(F.lit(-3.5), F.least(F.lit(3.5), (F.coalesce(c, F.lit(0.0)) - w[1]) / (w[2] if w[2] >= 1e-6 else 1.0))) * w[0], 4)
    rows = [F.struct(-F.abs(impact(c, w)), F.lit(i), F.struct(F.lit(c).alias("feature"), F.round(c, 4).alias("observed_value"), F.lit(round(reference.get(c, 0.0), 4)).alias("reference_mean"), impact(c, w).alias("impact_score"), F.when(impact(c, w) > 0, "AI-skewed").otherwise("Human-skewed").alias("direction"))) for i, (c, w) in enumerate(weights.items())]
    return F.transform(F.sort_array(F.array(*rows)), lambda x: x["col3"])


def gated(df: DataFrame) -> DataFrame:
    """What respond reads: the gate's columns, the cleaned text as text and the given one as raw.

    Words are counted in the cleaned text, which is measured; characters, paragraphs and spans are those of the raw one.
    """
    raw = F.coalesce("text", F.lit(""))
    counted = documents.gate(df.withColumn("raw", raw)).withColumns({"char_count": F.length("raw").cast("long"), "paragraph_count": F.regexp_count("raw", F.lit(documents.PARAGRAPH)).cast("long")})
    return counted.withColumn("text", F.col("cleaned")).drop("cleaned")


def with_spans(df: DataFrame) -> DataFrame:
    """highlighted_spans of the raw text (none where the status isn't SUCCESS), and sentence and severity counts."""
    none = F.slice(documents.evidence_array(F.lit("a")), 1, 0)
    out = df.withColumn("highlighted_spans", F.when(F.col("status") == "SUCCESS", documents.evidence_array(F.col("raw"))).otherwise(none))
    of = lambda *kinds: F.size(F.filter("highlighted_spans", lambda s: s["overall_severity"].isin(*kinds))).cast("long")
    return out.withColumns({"sentence_count": F.size("highlighted_spans").cast("long"), "flagged_sentence_count": of("high", "medium"), "high_severity_count": of("high"), "medium_severity_count": of("medium")})


METADATA = ("word_count", "char_count", "paragraph_count", "sentence_count", "flagged_sentence_count", "high_severity_count", "medium_severity_count")


def respond(df: DataFrame, measure: Callable[[DataFrame], DataFrame], weights: dict[str, tuple[float, float, float]], intercept: float, reference: dict[str, float], top: int = 5, version: str = VERSION) -> DataFrame:
    """df: what gated() gives. doc_id, status, code, metadata, assessment, evidence, highlighted_spans, disclaimers of each row.

    Measurements are taken from the cleaned text, spans and their offsets, paragraphs and the dispersion of measurements
    between them from the raw one. A text that is empty or under 20 words has only metadata; one under 75 words has
    probability 0.5, no contributions, but spans. Repeated rows stay.
    """
    out = documents.verdict(documents.undecided(model.score(measure(df), weights, intercept)))
    read, judged = F.col("status") == "SUCCESS", F.col("code").isNull()
    out = with_spans(out)
    out = out.withColumn("_drivers", F.when(judged, _drivers(weights, reference)))
    way = lambda d: F.slice(F.filter("_drivers", lambda x: x["direction"] == d), 1, top)
    return out.select(
        "doc_id", "status", "code", F.lit(version).alias("model_version"),
        F.struct(*METADATA).alias("metadata"),
        F.when(read, F.struct("category", F.col("verdict").alias("verdict_code"), F.col("colour").alias("verdict_color"), F.col("confidence").alias("confidence_level"), F.round("probability", 4).alias("calibrated_ai_probability"), (~judged).alias("is_indeterminate"), F.round("logit", 4).alias("logit_score"), documents.summary(F.col("verdict"), F.col("flagged_sentence_count")).alias("summary"))).alias("assessment"),
        F.when(read, F.struct(way("AI-skewed").alias("top_ai_evidence"), way("Human-skewed").alias("top_human_evidence"), F.create_map(*(x for c in weights for x in (F.lit(c), F.round(c, 4)))).alias("all_feature_measurements"))).alias("evidence"),
        "highlighted_spans",
        F.struct(*(F.lit(text).alias(k) for k, text in documents.DISCLAIMERS.items())).alias("disclaimers"),
    )

"""Streams against the same operators on whole tables, with restarts and new versions of a model in the middle."""

import pytest
from pyspark.sql import functions as F

from quillspark.operators import corpus, documents, model
from quillspark.sources import files
from quillspark.streaming import dedupe, score

WEIGHTS = {"surface_ttr": (-0.8, 0.6, 0.12), "surface_word_entropy": (0.5, 6.5, 1.1), "surface_comma_rate": (0.3, 6.0, 3.0)}


def test_scored_as_a_table(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(12)
    docs.write.parquet(f"{tmp_path}/in")
    query = score.scored(spark, f"{tmp_path}/in", "doc_id long, text string", WEIGHTS, 0.1).writeStream.format("memory").queryName("scored").trigger(availableNow=True).start()
    query.awaitTermination()
    gated = documents.gate(spark.read.parquet(f"{tmp_path}/in")).withColumn("text", F.col("cleaned"))
    want = documents.verdict(documents.undecided(model.score(documents.features(gated), WEIGHTS, 0.1))).select("doc_id", "word_count", "probability", "verdict", "confidence")
    assert sorted(map(str, spark.table("scored").collect())) == sorted(map(str, want.collect())) and want.count() == 12


def test_a_model_is_replaced_while_the_stream_runs(spark, tmp_path):
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) > 800").select("doc_id", "text").limit(30).collect()
    models, inside, out = (f"{tmp_path}/{n}" for n in ("models", "in", "out"))
    schema = "doc_id long, text string"
    with pytest.raises(FileNotFoundError):
        files.newest_version(spark, models)
    heavier = {k: (3 * w, m, s) for k, (w, m, s) in list(WEIGHTS.items())[:2]}  # a feature goes: it counts nothing
    for version, weights, rows in ((1, WEIGHTS, texts[:15]), (2, heavier, texts[15:])):
        files.add_version(spark, models, version, weights, 0.1 * version)
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inside)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(inside)
        score.score_by_versions(stream, models, list(WEIGHTS), out, f"{tmp_path}/checkpoint", documents.surface).awaitTermination()
    spark._jvm.java.io.File(f"{models}/version=3").mkdirs()  # not finished: nobody reads it
    got = {r.doc_id: r for r in spark.read.parquet(out).collect()}
    assert {r.version for r in got.values()} == {1, 2} and len(got) == 30 and files.newest_version(spark, models).first().version == 2
    gated = documents.gate(spark.createDataFrame(texts, schema)).withColumn("text", F.col("cleaned"))
    for version, weights, own in ((1, WEIGHTS, texts[:15]), (2, heavier, texts[15:])):
        want = {r.doc_id: r.probability for r in documents.undecided(model.score(documents.surface(gated), weights, 0.1 * version)).collect()}
        for r in own:
            assert got[r.doc_id].version == version and got[r.doc_id].probability == pytest.approx(want[r.doc_id])


def test_dedupe_after_a_restart(spark, tmp_path):
    long = lambda i: f"The beginning of text number {i} goes on for long enough to be compared with others. " + " ".join(f"word{i}x{j}" for j in range(40))
    rows = [(1, long(1)), (2, long(2)), (3, long(1)), (4, long(1) + " another end"), (5, "short"), (6, None), (7, "- " * 40 + long(7)), (8, long(8))]
    rows += [(9, long(2) + " more"), (10, long(8)), (11, "- " * 40 + long(7)), (12, "- " * 40 + long(12)), (13, long(13)), (14, long(13)), (15, long(1)), (16, long(16))]
    table = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string").withColumn("ts", F.timestamp_seconds(F.col("doc_id") * 60))
    inside, out = f"{tmp_path}/in", f"{tmp_path}/out"

    def run():
        stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(inside)
        dedupe.first_of_each(stream).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/checkpoint").outputMode("append").trigger(availableNow=True).start(out).awaitTermination()

    for half in ("doc_id <= 8", "doc_id > 8"):  # the query ends after the first half, and a new one goes on
        table.where(half).coalesce(1).write.mode("append").parquet(inside)
        run()
    got = sorted(r.doc_id for r in spark.read.schema(dedupe.KEPT).parquet(out).collect())
    good = corpus.drop_malformed(table).select("doc_id", "cleaned")
    assert got == sorted(r.doc_id for r in corpus.near_dedupe(corpus.exact_dedupe(good)).collect()) == [1, 2, 7, 8, 12, 13, 16]


def test_checked_write(spark, tmp_path):
    sound = spark.createDataFrame([(1, 0.5), (2, 1.5)], "id int, v double")
    assert files.write_checked(sound, f"{tmp_path}/sound", ["v"]) == {"rows": 2, "nulls": 0, "nans": 0, "infinite": 0}
    assert spark.read.parquet(f"{tmp_path}/sound").count() == 2
    for bad in (None, float("nan"), float("inf"), -float("inf")):
        with pytest.raises(files.UnsoundTable):
            files.write_checked(sound.union(spark.createDataFrame([(3, bad)], "id int, v double")), f"{tmp_path}/bad", ["v"])
        assert not (tmp_path / "bad").exists()
    assert files.write_checked(sound.limit(0), f"{tmp_path}/none", ["v"])["rows"] == 0


def test_many_offsets(spark):
    text = "One here. Two there! “Three?” Four.\nstill five\n\n  Next paragraph. End"
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "x. " * 3000)], "doc_id long, text string")
    spans = {i: [r for r in documents.sentence_spans(docs.where(f"doc_id = {i}")).orderBy("sentence_idx").collect()] for i in (1, 2, 3, 4)}
    asked = [(1, k) for k in range(-3, len(text) + 5)] * 2 + [(2, 0), (3, 0), (None, 4), (9, 1), (1, None)] + [(4, k) for k in range(0, 9100, 7)]
    got = documents.sentence_at(docs, spark.createDataFrame(asked, "doc_id long, offset long"), most=16).collect()
    assert len(got) == len(asked)
    for r in got:
        own = [s.sentence_idx for s in spans.get(r.doc_id, []) if r.offset is not None and s.start_char <= r.offset < s.end_char]
        assert r.sentence_idx == (own[0] if own else None), r

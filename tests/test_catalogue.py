"""Queries against their SQL on the smallest tables, and rules on sentences of our own."""

import json
import os
import re

import duckdb
import numpy as np
import pytest

from quillspark.functions import lexicon, registry
from quillspark.functions import text as X
from quillspark.operators import corpus, documents, model, response
from quillspark.plans import catalogue
from quillspark.sources import files

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"create view {f[:-8]} as select * from read_parquet('{DIR}/{f}')")
    return con


def canon(rows):
    return sorted((tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", ["word_tokens", "sentence_spans", "bigram_entropy", "agency", "causal_temporal", "near_dedupe", "contributions_topk", "confusion_metrics", "topic_slices", "prefix_suffix_strip", "analysis", "gates", "clean_audit", "exact_dedupe", "sentence_evidence", "severity_counts", "response_metadata", "reflection_position", "audit", "grouped_split", "split_stats", "display_text", "anomaly_topk"])
def test_matches_sql(spark, db, name):
    got = catalogue.QUERIES[name](spark, DIR)
    cols = sorted(got.columns)
    want = db.execute(catalogue.ORACLE_SQL[name]).to_arrow_table().select(cols).to_pylist()
    assert canon(tuple(r) for r in got.select(cols).collect()) == canon(tuple(r[c] for c in cols) for r in want)


@pytest.mark.parametrize("name", ["sentence_evidence", "severity_counts"])
def test_evidence_sql(spark, tmp_path, name):
    """Documents of our own that give every rule; the driver's hold none of its words."""
    shown = [p.replace(r"\b", "").replace("(?:", "").replace(")?", "").replace(")", "") for p in lexicon.FORMULAIC]
    made = [f"Now {p} indeed. I {v} it. My {a} sat {k}.\n\nA {k} {a}, the {a}: one two three." for p, v, a, k in zip(shown * 5, lexicon.PASSIVE_STATE_VERBS * 9, lexicon.ABSTRACT, lexicon.CONCRETE)]
    made += ["We repaired the bicycle in the garage.", "Résumé tapestry éclat. " + "word " * 60 + "tapestry. Nothing here.", "", None]
    spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").toPandas().to_parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet')")
    got = catalogue.QUERIES[name](spark, str(tmp_path))
    cols = sorted(got.columns)
    want = con.sql(catalogue.ORACLE_SQL[name]).to_arrow_table().select(cols).to_pylist()
    rows = [tuple(r) for r in got.select(cols).collect()]
    assert canon(rows) == canon(tuple(r[c] for c in cols) for r in want)
    if name == "sentence_evidence":
        assert {r[cols.index("overall_severity")] for r in rows} == {"high", "medium", "human_grounded", "neutral"}
        assert {x.split(":")[0].split("_", 1)[1] for r in rows for x in r[cols.index("rules")].split(",") if x} == {"abstract_vocab_density", "formulaic_moral_density", "agency_passive_density", "concrete_sensory_density", "paragraph_abstraction"}


def table(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_clean(spark):
    r = documents.clean(table(spark, "Here is an admissions essay: We built it.\n\nTwo; parts — kept.\n\nNote: done", None, "")).orderBy("doc_id").collect()
    assert r[0].cleaned == "We built it.\n\nTwo; parts — kept." and r[0].removed_prefixes == 1 and r[0].removed_suffixes == 1 and r[0].paragraph_count == 2
    assert r[1].is_empty and r[2].is_empty


def test_spans(spark):
    text = "One here. “Two there!” Three.\nstill first\n\nNext paragraph? Yes"
    rows = documents.sentence_spans(table(spark, text)).orderBy("sentence_idx").collect()
    assert all(text[r.start_char : r.end_char] == r.text for r in rows)
    assert [r.paragraph_idx for r in rows] == [0, 0, 0, 0, 1, 1]
    assert documents.sentence_spans(table(spark, "", None)).count() == 0


def test_evidence(spark):
    t = table(spark, "The tapestry of resilience is profound.\n\nWe repaired the bicycle in the garage.\n\nI felt small. It rained.")
    got = [r.overall_severity for r in documents.evidence(t).orderBy("sentence_idx").collect()]
    assert got == ["high", "human_grounded", "medium", "neutral"]


def test_evidence_items(spark):
    text = "The tapestry of resilience is profound, in conclusion."
    items = documents.evidence(table(spark, text)).first()["items"]
    assert [i.feature_name for i in items] == ["discourse_abstract_vocab_density", "discourse_formulaic_moral_density"] and len(items[0]) == 14
    assert items[0].deviation_z > 0 and "'profound', 'resilience', 'tapestry'" in items[0].explanation and "in conclusion" in items[1].explanation
    assert all((i.start_char, i.end_char, i.text, i.evidence_strength) == (0, len(text), text, "Strong") for i in items)


def test_response_spans_are_of_the_raw_text(spark):
    body = "We repaired the bicycle in the garage. The tapestry of resilience is profound! " + "It rained on the roof all day. " * 4
    texts = [
        f"Here is an admissions essay: {body}\n\n\nSecond paragraph, with a “quote.” Then more.\n\nI hope this essay helps you.",
        f"Title: Things\n\n{body}\r\nOne more line.\r\n\r\nWord count: 40",
        f"  \n# Header\n\n{body}\n \n{body}",
        f"ﬁrst ½ {body}",  # NFKC changes the cleaned text's length
        "Too short.", "", None,
    ]
    for r, text in zip(response.with_spans(response.gated(table(spark, *texts))).orderBy("doc_id").collect(), texts):
        raw = text or ""
        assert r.char_count == len(raw) and r.raw == raw
        assert all(raw[s.start_char : s.end_char] == s.text for s in r.highlighted_spans)
        assert r.sentence_count == len(r.highlighted_spans) and (r.sentence_count > 4) == (r.status == "SUCCESS")
        assert all(raw[i.start_char : i.end_char] == i.text for s in r.highlighted_spans for i in s["items"])
        if r.status == "SUCCESS":
            assert r.high_severity_count >= 1
            assert r.paragraph_count == len(re.findall(r"[^\n]+(?:\n[^\n]+)*", raw))


def test_dedupe_keeps_one_of_each(spark):
    long = "The same beginning of a text that is long enough to compare, "
    rows = [(1, "a"), (1, "a"), (None, "b"), (None, "b"), (2, "a"), (3, None), (4, long + "one"), (None, long + "two"), (4, long + "one")]
    df = spark.createDataFrame(rows, "doc_id long, cleaned string")
    exact = corpus.exact_dedupe(df)
    assert sorted((r.doc_id, r.cleaned) for r in exact.where("cleaned is not null and length(cleaned) > 1").collect() if r.doc_id) == [(4, long + "one")]
    assert exact.count() == 5 and exact.where("cleaned = 'a'").first().doc_id == 1
    assert sorted(map(str, (r.doc_id for r in corpus.near_dedupe(exact).collect()))) == ["1", "3", "4", "None"]


def test_gated_texts_have_no_verdict(spark):
    words = lambda n: " ".join(f"word{i}" for i in range(n))
    gated = documents.gate(table(spark, "", words(8), words(36), words(130)))
    scored = gated.withColumns({"logit": X.F.lit(3.0), "probability": X.F.lit(0.95)})
    r = documents.verdict(documents.undecided(scored)).orderBy("doc_id").collect()
    assert [x.status for x in r] == ["ERROR", "INSUFFICIENT_LENGTH", "SUCCESS", "SUCCESS"]
    assert [x.probability for x in r] == [None, None, 0.5, 0.95] and [x.logit for x in r] == [None, None, 0.0, 3.0]
    assert r[2].category == "Insufficient Evidence" and r[2].verdict == "INSUFFICIENT_EVIDENCE" and r[2].confidence == "N/A (Short Text)" and r[3].verdict == "LIKELY_AI_GENERATED" and r[3].confidence == "High"


def test_integrity_and_tallies(spark):
    df = spark.createDataFrame([(1.0, "a", "train", 0), (float("nan"), None, "train", 1), (float("inf"), "a", "test", 1), (None, "b", "test", 0)], "v double, source string, split string, label int")
    assert tuple(corpus.integrity(df, ["v"]).first()) == (4, 1, 1, 1)
    assert sorted(tuple(r) for r in corpus.tallies(df, "source").collect()) == [("source", "None", 1), ("source", "a", 2), ("source", "b", 1)]
    assert sorted(tuple(r) for r in corpus.split_stats(df).collect()) == [("test", 2, 2, 0.5, 1, 1), ("train", 1, 2, 0.5, 1, 1)]


def test_baseline(spark):
    rng = X.F.rand(1)
    df = spark.range(200).select("id", X.F.randn(1).alias("a"), X.F.randn(2).alias("b"), (rng * 3).alias("c"))
    rows = np.array([[r.a, r.b, r.c] for r in df.collect()])
    base = model.fit_baseline(df, ["a", "b", "c"])
    assert np.allclose(base["mean"], rows.mean(0)) and np.allclose(base["std"], rows.std(0))
    assert np.allclose(base["inverse"], np.linalg.pinv(np.corrcoef(rows.T) + 1e-3 * np.eye(3)))


def test_passive_ratio(spark):
    tags = lambda *t: X.F.array(*map(X.F.lit, t))
    row = spark.range(1).select(documents.passive_ratio(tags("BE", "VBN", "BE", "RB", "VBN", "BE", "NN"), X.F.lit(4)), documents.passive_ratio(tags("NN", "VB"), X.F.lit(0))).first()
    assert tuple(row) == (0.5, 0.0)


def test_sources_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("human_1", 'two\nlines, "quoted"', 0.25), ("ai_2", None, None)], "essay_id string, text string, v double")
    files.write_table(df, f"{tmp_path}/t")
    assert sorted(map(str, files.read_table(spark, f"{tmp_path}/t", df.schema.simpleString()[7:-1].replace(":", " ")).collect())) == sorted(map(str, df.collect()))
    files.write_lines(df, f"{tmp_path}/l")
    assert files.read_corpus(spark, f"{tmp_path}/l").count() == 2
    base = {"mean": np.zeros(2), "std": np.ones(2), "inverse": np.eye(2)}
    files.save_artifact(spark, f"{tmp_path}/m", {"a": (1, 2, 3)}, 0.5, reference={"a": (0.1, 0.2)}, baseline=base)
    got = files.load_artifact(spark, f"{tmp_path}/m")
    assert got["weights"] == {"a": (1.0, 2.0, 3.0)} and got["reference"] == {"a": (0.1, 0.2)} and (got["baseline"]["inverse"] == np.eye(2)).all() and got["thresholds"] == [0.35, 0.65, 0.85]


def test_counts_and_measures(spark):
    r = documents.features(table(spark, "a b a c", "", None)).orderBy("doc_id").collect()
    assert r[0].surface_word_entropy == pytest.approx(1.5) and r[0].surface_ttr == 0.75
    assert r[1].surface_word_entropy == 0 and r[2].discourse_reflection_mean_pos == 0.5
    assert spark.range(1).select(X.counts(X.tokens(X.F.lit("x y x")))).first()[0] == [2, 1]


def test_split_has_no_leaks(spark):
    df = spark.createDataFrame([(i, f"g{i // 3}") for i in range(36)], "doc_id long, source string")
    out = corpus.grouped_split(df)
    assert corpus.leaks(out).count() == 0 and out.count() == 36 and {r.split for r in out.collect()} == {"train", "val", "test"}


def test_evaluate(spark):
    df = spark.createDataFrame([(0, 0, 0.1), (0, 1, 0.7), (1, 1, 0.8), (1, 1, 0.9)], "y int, pred int, p double")
    r = model.evaluate(df).first()
    assert (r.accuracy, r.fp, r.false_positive_rate, r.false_negative_rate, r.roc_auc) == (0.75, 1, 0.5, 0.0, 1.0)
    one = model.evaluate(spark.createDataFrame([(0, 0, 0.1)], "y int, pred int, p double")).first()
    assert one.roc_auc == 0.5 and one.accuracy == 1


def test_reflection_positions_sql(spark, tmp_path):
    """The driver's texts hold few of the words: these hold every pattern, next to each other, in other words and thousands of times."""
    words = ["realized", "discovering", "understanding", "understood", "learnt", "taught me", "perspective shifted", "concluded", "epiphany", "illuminate", "insight", "came to know", "opened my eyes"]
    made = [" ".join(["x"] * i + words[i % 13 :] + ["é" * i]) for i in range(40)] + ["unlearned learned. misunderstanding? INSIGHT insights", "insight " * 8000, "", None, "nothing", "Étaught me taught meé taught me"]
    spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").toPandas().to_parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet')")
    got = catalogue.QUERIES["reflection_position"](spark, str(tmp_path))
    cols = sorted(got.columns)
    assert canon(tuple(r) for r in got.select(cols).collect()) == canon(tuple(r[c] for c in cols) for r in con.sql(catalogue.ORACLE_SQL["reflection_position"]).to_arrow_table().select(cols).to_pylist())


def test_anomalies_are_not_clipped(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(50, 6))
    x[:, 5] = 3.0
    weights = {f"f{k}": (w, 0.0, 1.0) for k, w in enumerate((0.5, -2.0, 0.1, 1.0, -0.3, 4.0))}
    human = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{c} double" for c in weights))
    failed = [(1, 40.0, 0.1, 0.0, -9.0, 2.0, 3.0), (2, 0.0, 0.0, 0.0, 0.0, 0.0, 8.0)]
    for r in model.anomalies(spark.createDataFrame(failed, "doc_id long, " + ", ".join(f"{c} double" for c in weights)), human, weights).collect():
        std = x.std(0, ddof=1)
        z = (np.array(failed[r.doc_id - 1][1:]) - x.mean(0)) / np.where(std == 0, 1, std)
        impact = [round(a * w, 3) for a, (w, _, _) in zip(z, weights.values())]
        order = sorted(range(6), key=lambda k: -abs(impact[k]))[:4]
        assert [(t.feature, t.model_impact) for t in r.top_features] == [(f"f{k}", pytest.approx(impact[k], abs=1e-3)) for k in order]
    assert abs(impact[5]) > 3.5 * 4


def test_deal_is_greedy():
    for sizes in ([3] * 12, [50, 1, 1, 1], [1], [2, 9, 4, 4, 1, 7]):
        order, total, want = np.random.RandomState(42).permutation(len(sizes)), sum(sizes), [2] * len(sizes)
        train = val = 0
        for n, i in enumerate(order):
            if n == 0 or train + sizes[i] <= 0.7 * total:
                want[i], train = 0, train + sizes[i]
            elif 1 not in want or val + sizes[i] <= 0.15 * total:
                want[i], val = 1, val + sizes[i]
        assert corpus.deal(sizes) == want


def test_train_and_export_in_one_call(spark, tmp_path):
    """The artifact that is read again holds what the one in memory does, and gives responses."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet").join(spark.read.parquet(f"{DIR}/labels.parquet"), "doc_id")
    rows = docs.select("doc_id", "text", (1 - X.F.col("quality")).cast("int").alias("label"))
    made = response.train_and_export(rows, f"{tmp_path}/artifact", "7")
    read = files.load_artifact(spark, f"{tmp_path}/artifact")
    assert read["version"] == "7" and read["weights"] == made["weights"] and read["reference"] == made["reference"] and len(read["reference"]["surface_ttr"]) == 5
    assert all((read["baseline"][k] == made["baseline"][k]).all() for k in read["baseline"]) and read["intercept"] == made["intercept"]
    got = response.analyse(docs.select("doc_id", "text").limit(8), read).collect()
    assert len(got) == 8 and {r.model_version for r in got} == {"7"} and all(r.assessment is None or 0 < r.assessment.calibrated_ai_probability < 1 for r in got)
    human = [r for r in rows.where("label = 0").collect()]
    assert len(human) > 5 and set(read["weights"]) == set(response.COLUMNS)


def test_registry_tells_of_every_measurement():
    assert list(registry.FEATURES) == response.COLUMNS and all(len(t) == 4 and all(t) for t in registry.FEATURES.values())
    for c, (_, span, _, _) in registry.FEATURES.items():
        low, high = map(float, span.strip("[]").split(","))
        assert low < high, c


def test_records_and_defaults(spark):
    rows = [("human", "a_src1", "x"), ("ai", "a_zz", "y"), ("synthetic_polished", "a", "z"), (None, None, None)]
    got = files.with_prompt(files.literal_corpus(spark, rows), {"src1": "one"}, "other").orderBy("text").collect()
    assert [(r.essay_id and r.essay_id.split("_")[0], r.binary_label, r.generation_prompt) for r in got] == [(None, 0, "other"), ("human", 0, "one"), ("ai", 1, "other"), ("polished", 1, "other")]
    one = response.with_distances(table(spark, "some text"), None).first()
    assert [one[c] for c in documents.DISTANCES] == [0.0, 0.0, 1.0, 0.0]


def test_documents_sink(spark, tmp_path):
    df = spark.createDataFrame([("a", [1.5, None], {"k": 1}), ("b", [], {})], "s string, v array<double>, m map<string,int>")
    files.write_document(df, f"{tmp_path}/d")
    got = sorted((r.value for r in spark.read.text(f"{tmp_path}/d").collect()))
    assert [json.loads(x) for x in got] == [{"s": "a", "v": [1.5, None], "m": {"k": 1}}, {"s": "b", "v": [], "m": {}}]

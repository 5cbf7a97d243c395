"""Counts over Arrow batches against plain restatements, in one piece and in slices."""

import math
from collections import Counter

import pyarrow as pa
import pytest

from quillspark.functions import counted, lexicon

TEXTS = ["I led a band, then felt tapestry: 12 of us sang loudly -- in \"mud\" (wet).", "", "my my my my my", "é 😀😀 ness a b a b", "; ; ;", "word " * 900 + "i was told i decided", None]


def plain(text, tokens):
    bits = lambda values: -sum(k / len(values) * math.log2(k / len(values)) for k in Counter(values).values()) if values else 0.0
    if not tokens:
        return (0.0,) * 6
    k = sorted(Counter(tokens).values(), reverse=True)
    return bits(text), bits(tokens), bits(list(zip(tokens, tokens[1:]))), k.count(1) / len(k), sum(k[:10]) / len(tokens), sum(text.count(c) for c in "—–-") / len(tokens) * 100


@pytest.mark.parametrize("most", [1, 7, 200_000])
def test_counts(spark, monkeypatch, most):
    monkeypatch.setattr(counted, "WORDS", most)
    monkeypatch.setattr(counted, "SIGNS", most)
    cut = [["".join(c for c in x if c.isalnum()) for x in (t or "").lower().split()] for t in TEXTS]
    tokens = [[x for x in own if x] for own in cut]
    lists = pa.array(tokens, pa.list_(pa.string()))
    got = counted.surface.func(pa.array([t or "" for t in TEXTS]), lists, lists).to_pylist()
    for t, own, r in zip(TEXTS, tokens, got):
        want = plain(t or "", own)
        assert [r[c] for c in ("char_entropy", "word_entropy", "bigram_entropy", "hapax_ratio", "top10_concentration", "emdash_rate")] == pytest.approx(want, abs=1e-9)
        assert r["stopword_ratio"] == pytest.approx(sum(x in lexicon.STOPWORDS for x in own) / max(len(own), 1))
    found = [tuple(r.values()) for r in counted.vocabulary.func(lists, lists).to_pylist()]
    assert found[0] == (1, 0, 1, 2) and found[5] == (1, 0, 0, 0) and found[6] == (0, 0, 0, 0)


def test_no_rows(spark):
    none = pa.array([], pa.list_(pa.string()))
    assert len(counted.surface.func(pa.array([], pa.string()), none, none)) == 0 and len(counted.vocabulary.func(none, none)) == 0


def test_counting_leaves_the_plan(spark):
    """Words are no longer told apart by sorting and comparing arrays in the plan, which took most of a response's time."""
    from quillspark.operators import documents

    plan = documents.features(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array" not in plan

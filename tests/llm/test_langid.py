"""Code lengths, predictions and the pipeline's stage against prediction by partial matching written out byte by byte."""

import math
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from quillspark.llm import langid


class Plain:
    """Counts of next bytes after each context of up to ``order`` bytes, and probabilities with exclusion, one symbol at a time."""

    def __init__(self, texts, labels, order, least):
        self.languages, self.order = sorted(set(labels)), order
        texts = [t.encode().replace(b"\0", b" ") for t in texts]
        self.alphabet = {b for t in texts for b in t}
        self.after = {k: {} for k in self.languages}
        grams = {k: Counter() for k in self.languages}
        for t, k in zip(texts, labels):
            for n in range(order + 1):
                for i in range(len(t) - n):
                    self.after[k].setdefault(t[i : i + n], Counter())[t[i + n]] += 1
            for n in range(1, order + 1):
                grams[k].update(t[i : i + n] for i in range(len(t) - n + 1))
        self.kept = {b""}
        for n in range(1, order + 1):
            self.kept |= {g for k in self.languages for g, c in grams[k].items() if len(g) == n and c >= least and g[1:] in self.kept}

    def probability(self, k, context, byte):
        p, excluded = 1.0, set()
        while True:
            seen = self.after[k].get(context, Counter())
            own = {b: c for b, c in seen.items() if b not in excluded}
            total, kinds = sum(own.values()), len(own)
            if byte in own:
                return p * own[byte] / (total + kinds)
            if kinds:
                p *= kinds / (total + kinds)
            excluded |= set(own)
            if not context:
                return p / (256 - len(excluded))
            context = context[1:]

    def bits(self, k, text):
        out = 0.0
        for i, byte in enumerate(text):
            context = next(text[i - n : i] for n in range(min(i, self.order), -1, -1) if text[i - n : i] in self.kept)
            out -= math.log2(self.probability(k, context, byte))
        return out


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(8)
    made = []
    for k, words in (("en", "the river and a stone of this old town is here".split()), ("de", "der Fluss und ein Stein über die alte Stadt ist hier".split()), ("fr", "le fleuve était une pierre à côté de la vieille ville".split())):
        made += [(" ".join(rng.choice(words, 25)), k) for _ in range(14)]
    return made


@pytest.mark.parametrize("order", [0, 1, 3])
def test_code_lengths(corpus, order):
    texts, labels = zip(*corpus)
    model, plain = langid.fit_bytes(list(texts), list(labels), order, 4), Plain(texts, labels, order, 4)
    assert model.languages == plain.languages
    asked = [texts[0][:90], texts[20][:90], "über the côté 42 \x00 語", "zzzz", "", "e", "the " * 200]
    got = langid.code_lengths(model, [t.encode() for t in asked])
    for row, t in zip(got, asked):
        assert row == pytest.approx([plain.bits(k, t.encode()) for k in plain.languages], rel=2e-5, abs=1e-6)


def test_predictions_and_the_stage(spark, corpus):
    texts, labels = zip(*corpus)
    rows = [(i, t, k, "s", len(t)) for i, (t, k) in enumerate(corpus)]
    odd = [(900, None), (901, "12 ..."), (902, "語語語語語語語語"), (903, "the stone und la ville"), (None, "der Fluss ist hier"), (903, "the stone und la ville")]
    docs = spark.createDataFrame(rows + [(i, t, None, "s", None) for i, t in odd], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    model = langid.fit(docs, min_count=4)
    train = langid.training_rows(docs).collect()
    plain = Plain([r.text for r in train], [r.lang for r in train], 3, 4)
    assert len(train) < len(corpus) and model.languages == plain.languages
    for r in langid.identify(docs, model).collect():
        text = dict([(i, t) for i, t, *_ in rows] + odd)[r.doc_id]
        if text is None or not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score, r.bits_per_byte) == ("und", 0.0, None)
            continue
        bits = np.array([plain.bits(k, text.encode()) for k in plain.languages])
        assert r.lang_pred == plain.languages[bits.argmin()] and r.score == pytest.approx(1 / np.exp2(np.maximum(bits.min() - bits, -1000)).sum(), abs=1e-4)
    # The stage: what is as short in raw bytes as in every language goes.
    stage = Plain([r.text for r in train], [r.lang for r in train], 3, 16)
    want = sorted(str(i) for i, t in [(i, t) for i, t, *_ in rows] + odd if t and any(c.isalpha() for c in t) and min(stage.bits(k, t.encode()) for k in stage.languages) < 8 * len(t.encode()))
    assert sorted(str(r.doc_id) for r in corpus_pipeline.language(spark, docs, "").collect()) == want and "902" not in want

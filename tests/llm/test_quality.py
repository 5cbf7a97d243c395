"""The quality classifier against plain restatements, and its accuracy on held-out documents."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import quality, tokens

DOCS, LABELS = "doc_id long, text string, quality int, score double, held string", "doc_id long, quality int, text string"


def tables(spark, docs, labels):
    return spark.createDataFrame([(i, t, 9, 9.0, "x") for i, t in docs], DOCS).repartition(3), spark.createDataFrame([(i, q, "clash") for i, q in labels], LABELS)


def words_of(text):
    """Each token's bucket and index vector."""
    out = []
    for _, prints, _ in tokens.fingerprints(pa.array([text]), tokens.KINDS, tokens.EXACT):
        place, sign = quality.index_entries(prints)
        for n, b in enumerate(quality.buckets(prints).tolist()):
            v = np.zeros(quality.DIM)
            for p, s in zip(place[:, n], sign[:, n]):
                v[p] += s
            out.append((b, v))
    return out


def plain_vectors(texts):
    sums, held = {}, {}
    for t in texts:
        own = words_of(t or "")
        for i, (b, _) in enumerate(own):
            held[b] = held.get(b, 0) + 1
            sums[b] = sums.get(b, 0) + sum((own[j][1] for j in range(max(0, i - quality.WINDOW), min(len(own), i + quality.WINDOW + 1)) if j != i), np.zeros(quality.DIM))
    mean = sum(sums.values()) / sum(held.values())
    return {b: (v := s / held[b] - mean) / max(np.linalg.norm(v), 1e-12) for b, s in sums.items()}


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "river", "stone", "walked", "home", "late", "again,", "bright."], n))


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(4)
    docs, labels = [], []
    for i in range(600):
        good = i % 4 != 0
        text = prose(rng, int(rng.integers(30, 90)))
        if not good:
            text = [" ".join(w + "%%%" for w in text.split()), text.upper(), " ".join([text.split()[0]] * 40), " | ".join(text.split())][i // 4 % 4]
        docs.append((i, text))
        labels.append((i, int(good)))
    return docs, labels


def test_tokens_are_words_and_marks():
    assert [s.tolist() for _, _, s in tokens.fingerprints(pa.array(["Big big*** b--c d", None]), tokens.KINDS, tokens.EXACT)] == [[7, 0]]
    a, b = words_of("Big big")
    assert a[0] != b[0]


def test_vectors_and_pooling(spark, corpus, monkeypatch):
    docs = [*corpus[0][:40], (1000, None), (1001, ""), (1002, "one"), corpus[0][3]]
    d, _ = tables(spark, docs, [])
    got = quality.word_vectors(quality.word_contexts(d))
    want = plain_vectors([t for _, t in docs])
    assert set(np.flatnonzero(np.abs(got).sum(1))) == {b for b, v in want.items() if np.abs(v).sum() > 0}
    for b, v in want.items():
        assert got[b] == pytest.approx(v, abs=1e-5)
    for size in (quality.SLICE, 7):
        monkeypatch.setattr(quality, "SLICE", size)
        pooled = quality.pool(pa.array([t for _, t in docs]), got)
        for (_, t), p in zip(docs, pooled):
            v = [got[b].astype(np.float64) for b, _ in words_of(t or "")]
            n = max(len(v), 1)
            z = np.zeros(quality.DIM)
            assert p == pytest.approx(np.concatenate([sum(v, z) / n, sum((x * x for x in v), z) / n, sum((x * y for x, y in zip(v, v[1:])), z) / n]), abs=1e-5)


def test_temperature_is_the_least_loss():
    rng = np.random.default_rng(1)
    logits = rng.normal(size=4000) * 3
    y = (rng.random(4000) < 1 / (1 + np.exp(-logits / 2.5))).astype(int)
    t = quality.temperature_of(logits, y)
    assert t == pytest.approx(2.5, rel=0.1)
    assert all(quality.losses(logits / t, y) <= quality.losses(logits / u, y) + 1e-5 for u in np.geomspace(0.1, 10, 50))


def test_held_out_accuracy(spark, corpus):
    d, labels = tables(spark, *corpus)
    rows = {r.doc_id: r for r in quality.classify(d, labels).collect()}
    truth = dict(corpus[1])
    apart = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sorted(i for i, r in rows.items() if r.held_out) == apart
    assert np.mean([rows[i].predicted == truth[i] for i in apart]) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows.values())
    # labels of held-out documents, lang, source and ids play no part
    turned = spark.createDataFrame([(i, 1 - q if i in set(apart) else q, "x") for i, q in corpus[1]], LABELS)
    again = {r.doc_id: r.score for r in quality.classify(d, turned).collect()}
    assert again == pytest.approx({i: r.score for i, r in rows.items()}, abs=1e-9)


def test_odd_rows(spark, corpus):
    docs = [*corpus[0], (None, corpus[0][1][1]), (5, "twice"), (5, "twice"), (2000, None), (2001, ""), (2002, prose(np.random.default_rng(2), 60_000))]
    labels = [*corpus[1], (None, 1), (5, None), (5, 7), (6, 0), (6, 1), (4000, 1)]
    got = quality.classify(*tables(spark, docs, labels)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in docs)
    scores = {r.doc_id: r.score for r in got}
    assert scores[2000] == scores[2001] and scores[2002] > 0.7 and not next(r for r in got if r.doc_id is None).held_out


def test_one_label_and_empty_tables(spark, corpus):
    d, one = tables(spark, corpus[0][:50], [(i, 1) for i in range(50)])
    assert {r.predicted for r in quality.classify(d, one).collect()} == {1}
    _, none = tables(spark, [], [])
    assert {(r.score, r.predicted) for r in quality.classify(d, none).collect()} == {(0.5, 0)}
    assert quality.classify(d.limit(0), one).collect() == [] == quality.classify(d.limit(0), none).collect()


def test_sample_is_bounded(spark, corpus):
    d, labels = tables(spark, corpus[0] + corpus[0], corpus[1])
    assert quality.labelled_sample(d, labels, 50).count() == 50

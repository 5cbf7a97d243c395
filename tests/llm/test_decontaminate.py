"""Benchmark items planted in documents: how many are found, in parts of any size."""

import pickle

import numpy as np
import pytest

from quillspark.llm import decontaminate


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(6)
    vocabulary = np.array([f"{a}{b}{c}" for a in ("ba", "lo", "ti", "ne", "ru") for b in ("ma", "so", "vi", "ke", "du", "pa") for c in ("r", "n", "st", "l", "x", "m")])
    prose = lambda n: rng.choice(vocabulary, n).tolist()
    items = [(i, " ".join(prose(20)).capitalize() + ". " + " ".join(prose(int(rng.integers(8, 14)))).capitalize() + ".") for i in range(12)]
    docs, truth = [], {}

    def add(kind, i, words):
        docs.append((len(docs), " ".join(prose(int(rng.integers(60, 300))) + words + prose(int(rng.integers(60, 300))))))
        truth[len(docs) - 1] = (kind, i)

    for i, text in items:
        words = text.split()
        for _ in range(4):
            add("copy", i, words)
            gone = set(rng.choice(len(words), int(0.3 * len(words)), replace=False).tolist())
            add("replaced", i, [prose(1)[0] if k in gone else w for k, w in enumerate(words)])
            add("paraphrase", i, [w if rng.random() > 0.5 else prose(1)[0] for w in words[:20]] + words[20:])
    for _ in range(60):
        docs.append((len(docs), " ".join(prose(int(rng.integers(50, 500))))))
    odd = [(9000, None), (9001, ""), (None, items[0][1]), (3, docs[3][1]), (9002, " ".join(prose(4000)) + " " + items[1][1] + " " + " ".join(prose(4000)))]
    d = spark.createDataFrame([(i, t, 0.5, "x") for i, t in docs + odd], "doc_id long, text string, overlap double, kind string").repartition(3)
    b = spark.createDataFrame([(i, t, "x") for i, t in [*items, (50, None), (51, ""), (2, items[2][1])]], "item_id long, text string, cosine string")
    return d, b, truth


def test_recall_and_precision(planted):
    docs, benchmark, truth = planted
    rows = decontaminate.contaminated(docs, benchmark).collect()
    found = {(r.doc_id, r.item_id) for r in rows}
    for kind, least in (("copy", 1.0), ("replaced", 0.95), ("paraphrase", 0.9)):
        own = [(d, i) for d, (k, i) in truth.items() if k == kind]
        assert np.mean([x in found for x in own]) >= least, kind
    clean = [x for x in found if x[0] is not None and x[0] < 9000 and truth.get(x[0], (0, -1))[1] != x[1]]
    assert len(clean) <= 0.02 * len(truth)
    assert (None, 0) in found and (9002, 1) in found and not {9000, 9001} & {d for d, _ in found}
    assert sum(r.doc_id == 3 for r in rows) == 2 * len({r.item_id for r in rows if r.doc_id == 3}) * (1 if truth[3][1] != 2 else 2)


def test_parts_by_bytes_give_the_same(planted):
    docs, benchmark, _ = planted
    rows = lambda **k: sorted(str((*r[:3], round(r.cosine, 4), *r[4:])) for r in decontaminate.contaminated(docs, benchmark, **k).collect())
    assert rows(part_bytes=40_000) == rows() != []
    assert decontaminate.contaminated(docs.limit(0), benchmark).count() == 0 == decontaminate.contaminated(docs, benchmark.limit(0)).count()


def test_bytes_are_bounded_from_above(spark):
    rng = np.random.default_rng(1)
    for n in (5, 40, 3000):
        text = " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
        project = np.zeros((decontaminate.FEATURES, decontaminate.RANK), np.float32)
        one = lambda k: len(pickle.dumps(decontaminate.Items([(i, text) for i in range(k)], project, project[0])))  # noqa: E731, B023
        size = spark.createDataFrame([(text,)], "text string").select(decontaminate.item_bytes(decontaminate.F.col("text"))).first()[0]
        assert (one(3) - one(1)) / 2 <= 1.2 * size

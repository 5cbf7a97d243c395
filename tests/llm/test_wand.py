"""Ranked search against plain restatements, and its blocks against every way to cut a list."""

import itertools
import math
import re

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import tokens, wand

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, k=10):
    terms = [(i, WORD.findall((t or "").translate(FOLD))) for i, t in docs]
    n_docs, n_terms = sum(bool(t) for _, t in terms), sum(len(t) for _, t in terms)
    out = []
    for item, text in items:
        found = []
        asked = {w: sum(w in t for _, t in terms) for w in set(WORD.findall((text or "").translate(FOLD)))}
        for i, t in terms:
            score = 0
            for w, df in asked.items():
                if tf := t.count(w):
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * (10**9 * tf // (1000 * tf + 8 * (10 + 90 * len(t) * n_docs // n_terms)))
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def ranked(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, 1, 2.0) for i, t in docs], "doc_id long, text string, rank int, score double").repartition(3)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in wand.rank(d, q, **more).collect()), key=str)


def test_tokens_match_the_pattern():
    texts = ["Ünïted we Stand 42", None, "", "x" * 5, "a-b_c\u00a0d\x7fe\x00f", "tail"]
    wanted = [WORD.findall((t or "").translate(FOLD)) for t in texts]
    known: dict = {}
    for first, prints, sizes in tokens.fingerprints(pa.array(texts)):
        assert first == 0 and sizes.tolist() == [len(w) for w in wanted]
        for w, p in zip(itertools.chain(*wanted), prints.tolist()):
            assert known.setdefault(w, p) == p
    assert len(set(known.values())) == len(known)
    sliced = pa.array(texts).slice(3, 2)
    assert [s.tolist() for _, _, s in tokens.fingerprints(sliced)] == [[1, 5]]  # a no-break space is part of a term


def test_parts_of_a_batch_agree(monkeypatch):
    texts = pa.array([f"word{i} other {'x' * (i % 7)}" for i in range(200)])
    whole = np.concatenate([p for _, p, _ in tokens.fingerprints(texts)])
    monkeypatch.setattr(tokens, "PART", 100)
    parts = list(tokens.fingerprints(texts))
    assert len(parts) > 20 and (np.concatenate([p for _, p, _ in parts]) == whole).all()


@pytest.mark.parametrize("seed", range(6))
def test_blocks_are_the_best_cut(seed):
    rng = np.random.default_rng(seed)
    lists = [rng.integers(1, 50, n) for n in (1, 9, 4, 7)]
    impacts, starts = np.concatenate(lists), np.cumsum([0, 1, 9, 4, 7])
    blocks, first = wand.cut_blocks(impacts, starts, longest=5, cost=1.5)
    for j, own in enumerate(lists):
        cuts = [*(blocks[first[j] : first[j + 1]] - starts[j]), len(own)]

        def error(c):
            return sum((b - a) * max(own[a:b]) for a, b in itertools.pairwise(c)) + 1.5 * own.mean() * (len(c) - 1)

        every = ([0, *c, len(own)] for n in range(len(own)) for c in itertools.combinations(range(1, len(own)), n))
        assert error(cuts) == pytest.approx(min(error(c) for c in every if all(b - a <= 5 for a, b in itertools.pairwise(c))))


def test_rank_against_brute_force(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)] + ["Élan", "ÉLAN", "Naïve", "42"]
    weights = 1 / np.arange(1, len(words) + 1)
    docs = [(int(i), " ".join(rng.choice(words, rng.integers(1, 60), p=weights / weights.sum()))) for i in range(150)]
    docs += [(7, docs[7][1]), (None, docs[9][1]), (900, None), (901, ""), (902, "... !"), *((1000 + i, "copy of w3 W4 w5") for i in range(40)), (999, "w1 " * 50_000)]
    items = [(i, " ".join(rng.choice(words, 8))) for i in range(12)] + [(3, "w3 w4 w5 copy"), (20, None), (21, ""), (22, "absent"), (None, "w1 w2"), (23, "w3 w3 W3")]
    assert ranked(spark, docs, items) == brute(docs, items)
    assert ranked(spark, docs, items, k=3, part_items=4) == brute(docs, items, 3)


def test_blocks_are_skipped():
    """A document of rare terms is found without reading most of a common term's list."""
    rng = np.random.default_rng(5)
    n = 5000
    held = np.where(np.arange(n) % 500 == 0, 2, 1)
    terms = np.concatenate([[1, 2] if h == 2 else [1] for h in held])
    batch = wand.shard_of(list(range(n)), rng.integers(5, 400, n), terms, np.ones(len(terms), np.int32), held, n, 200 * n)
    (shard,) = wand.shards([batch])
    best = shard.search(np.array([1, 2]), np.array([10, 9000]), 10)
    assert sorted(i for _, i in best) == list(range(0, n, 500)) and shard.read < n / 2
    assert sorted(shard.search(np.array([2, 3]), np.array([9000, 1]), 20)) == sorted(best_of_rare(shard, 9000))


def best_of_rare(shard, weight):
    at = slice(*shard.block_starts[shard.block_lists[1:]])
    return [(weight * s, i) for s, i in zip(shard.impacts[at].tolist(), shard.ords[at].tolist())]


def test_empty_tables(spark):
    assert ranked(spark, [], [(1, "a")]) == [] == ranked(spark, [(1, "a")], []) == ranked(spark, [], [])

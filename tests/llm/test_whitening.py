"""Whitening against big integers and a covariance written out."""

import math
from fractions import Fraction

import numpy as np
import pytest

from quillspark.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, component int, n string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, "clash") for i, v in rows], SCHEMA).repartition(3)


def exact(vectors):
    x = [[math.floor(64 * float(np.float32(c))) + 1000000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[k] for r in x) for k in range(d)]
    v = np.array([[float(Fraction(n * sum(r[i] * r[j] for r in x) - s[i] * s[j], n * n)) for j in range(d)] for i in range(d)])
    return x, s, v


def test_limb_products_are_exact():
    rng = np.random.default_rng(0)
    for top in (10, 10**6, 2**40, 2**62):
        x = rng.integers(-top, top, (50, 5))
        got = whitening.moments(x)
        for i in range(5):
            assert sum(int(p[i, 5]) << 16 * k for k, p in enumerate(got)) == sum(map(int, x[:, i]))
            for j in range(5):
                assert sum(int(p[i, j]) << 16 * k for k, p in enumerate(got)) == sum(int(a) * int(b) for a, b in x[:, [i, j]])


def test_products_in_parts_agree(monkeypatch):
    x = np.random.default_rng(1).integers(-(10**9), 10**9, (100, 4))
    whole = whitening.moments(x)
    monkeypatch.setattr(whitening, "ROWS", 7)
    assert (whitening.moments(x) == whole).all()


def test_against_brute_force(spark):
    rng = np.random.default_rng(2)
    good = [(i, rng.normal(size=6) * [5, 3, 2, 1, 0.5, 0.25]) for i in range(80)]
    good += [(3, good[3][1]), (None, good[4][1])]
    odd = [(200, None), (201, [None, 1, 2, 3, 4, 5]), (202, [float("nan")] * 6), (203, [1, 2, 3, 4, 5, float("inf")]), (204, [])]
    x, s, v = exact([e for _, e in good])
    n = len(x)
    e, u = np.linalg.eigh(v)
    got = whitening.whitened(table(spark, good + odd), 4).collect()
    assert len(got) == 4 * n and {r.component for r in got} == {1, 2, 3, 4} and {r.n for r in got} == {n}
    assert max(r.identity_error for r in got) < 1e-9
    rows: dict = {}
    for r in got:
        rows.setdefault((r.vec_id, r.component), []).append(r)
    for (i, _), own in zip(good, x):
        for k in range(1, 5):
            r = rows[i, k][0]
            assert len(rows[i, k]) == (2 if i == 3 else 1)
            assert r.deviation == sum((n * a - b) ** 2 for a, b in zip(own, s)) and r.deviation_digits is None
            wanted = float(np.array([float(Fraction(n * a - b, n)) for a, b in zip(own, s)]) @ u[:, -k]) / math.sqrt(e[-k])
            assert abs(r.whitened) == pytest.approx(abs(wanted), rel=1e-9, abs=1e-9)
            assert r.explained == pytest.approx(e[-k] / np.trace(v), rel=1e-9)
    for k in range(1, 5):  # one sign for all rows
        pairs = [(rows[i, k][0].whitened, float(np.array(own) @ u[:, -k] - np.array(s) / n @ u[:, -k])) for (i, _), own in zip(good, x)]
        assert len({a * b > 0 for a, b in pairs if abs(b) > 1e-3}) == 1


def test_large_entries_and_lengths(spark):
    rng = np.random.default_rng(3)
    big = [(i, rng.normal(size=3) * 1e9) for i in range(30)]
    short = [(100 + i, rng.normal(size=2)) for i in range(20)]
    got = whitening.whitened(table(spark, big + short)).collect()
    x, s, _ = exact([v for _, v in big])
    for (i, _), own in zip(big, x):
        want = sum((30 * a - b) ** 2 for a, b in zip(own, s))
        assert {(r.deviation, r.deviation_digits) for r in got if r.vec_id == i} == {(None, str(want)) if want >= 1 << 63 else (want, None)}
    assert {r.n for r in got if r.vec_id < 100} == {30} and {(r.n, r.component) for r in got if r.vec_id >= 100} == {(20, 1), (20, 2)}


def test_null_directions_and_empty_tables(spark):
    line = [(i, [i, 2 * i, 5]) for i in range(10)]
    got = whitening.whitened(table(spark, line)).collect()
    assert len(got) == 10 and {r.component for r in got} == {1} and got[0].identity_error < 1e-9
    for rows in ([], [(1, [1, 2, 3])], [(1, None)], [(1, [4, 4]), (2, [4, 4])]):
        assert whitening.whitened(table(spark, rows)).collect() == []

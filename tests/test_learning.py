"""Fits and importances against NumPy restatements."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler

from quillspark.operators import model, ranks
from quillspark.sources import files


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 5)) * [1, 3, 0.1, 10, 1] + [0, 5, 1, -3, 0]
    x[:, 4] = 2.0  # never changes
    y = (x[:, 0] - 0.4 * (x[:, 1] - 5) + rng.logistic(size=400) > 0).astype(int)
    df = spark.createDataFrame([(i, *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y))], "doc_id long, a double, b double, c double, d double, e double, label int").repartition(5)
    return files.stage(df), x, y


def test_many_fits_in_the_same_scans(spark, data):
    df, x, y = data
    families = {"one": ["a"], "two": ["a", "b"], "all": list("abcde"), "other": ["d", "c"]}
    got = model.fit_many(df, families)
    for name, own in families.items():
        at = ["abcde".index(c) for c in own]
        z = np.column_stack([(x[:, at] - x[:, at].mean(0)) / np.where(x[:, at].std(0) > 0, x[:, at].std(0), 1), np.ones(len(y))])
        w = np.append([got[name][0][c][0] for c in own], got[name][1])
        gradient = z.T @ (1 / (1 + np.exp(-z @ w)) - y) + np.append(w[:-1], 0)
        assert np.abs(gradient).max() < 1e-6, name  # the one minimum of a convex loss
        if name != "all":
            continue
        ready = VectorAssembler(inputCols=own, outputCol="x").transform(model.standardise(df, own))
        m = LogisticRegression(featuresCol="x", labelCol="label", regParam=1 / len(y), standardization=False, maxIter=1000, tol=1e-12).fit(ready)
        assert w[:-1] == pytest.approx(m.coefficients.toArray(), abs=1e-3) and w[-1] == pytest.approx(m.intercept, abs=1e-3)
    assert model.fit_logistic(df, ["a", "b"])[0]["a"] == pytest.approx(got["two"][0]["a"])


def test_fit_of_separable_and_single_rows(spark):
    apart = spark.createDataFrame([(float(i), int(i > 10)) for i in range(20)], "a double, label int")
    weights, _ = model.fit_logistic(apart, ["a"])
    assert 1 < weights["a"][0] < 10
    one = spark.createDataFrame([(1.0, 1), (None, None)], "a double, label int")
    assert model.fit_logistic(one, ["a"])[0]["a"][0] == 0


def test_forest_as_arrays(spark, data):
    df, x, _ = data
    m = model.fit_forest(df, list("abcde"))
    p = np.mean([model.tree_votes(t, x) for t in model.trees_of(m)], axis=0)
    got = {r.doc_id: r.p for r in model.predict_forest(m, df, list("abcde")).collect()}
    assert [got[i] for i in range(len(x))] == pytest.approx(p.tolist(), abs=1e-9)


def test_forest_predicts_after_an_observed_write(spark, data, tmp_path):
    """A session that has observed a write can't be sent to tasks; the model's summary holds it."""
    df, _, _ = data
    files.write_checked(df, f"{tmp_path}/checked", list("ab"))
    m = model.fit_forest(df, list("ab"))
    assert all(0 <= r.p <= 1 for r in model.predict_forest(m, df, list("ab")).collect())
    assert m.getFeaturesCol() == "x"  # the given model stays as it is


def test_permutation_importance(spark, data):
    df, x, y = data
    columns = list("abcde")
    m = model.fit_forest(df.where("doc_id < 300"), columns)
    held = df.where("doc_id >= 300")
    numbered, n = ranks.numbered(held.select("doc_id"))
    got = {r.feature: r for r in model.permutation_importance(m, held, columns, repeats=6, seed=5).collect()}
    at = {r.row: r.doc_id for r in numbered.collect()}
    order = np.array([at[i] for i in range(n)])
    trees = model.trees_of(m)
    right = lambda v: np.mean((np.mean([model.tree_votes(t, v) for t in trees], axis=0) >= 0.5 - 1e-12) == y[order])
    own = x[order]
    for k, c in enumerate(columns):
        lost = []
        for turn in range(6):
            a, b = ranks.permutation(n, 5, turn)
            dealt = own.copy()
            dealt[:, k] = own[(a * np.arange(n) + b) % n, k]
            lost.append(right(own) - right(dealt))
        assert got[c].permutation_mean == pytest.approx(np.mean(lost), abs=1e-9) and got[c].permutation_std == pytest.approx(np.std(lost), abs=1e-9)
    assert got["a"].permutation_mean > 0.05 > abs(got["e"].permutation_mean)
    assert model.permutation_importance(m, held.limit(0), columns).count() == 0

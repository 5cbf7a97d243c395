"""Geometry, linear scoring, learning and evaluation over tables of measurements."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import files
from . import ranks


def moments(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each column, in one pass."""
    row = df.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    return {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 0.0) for c in columns}


def standardise(df: DataFrame, columns: list[str], stats: dict | None = None) -> DataFrame:
    """(x - mean) / deviation; a deviation of zero counts as 1."""
    stats = stats or moments(df, columns)
    return df.withColumns({c: (F.col(c) - stats[c][0]) / (stats[c][1] or 1.0) for c in columns})


def fit_baseline(df: DataFrame, columns: list[str]) -> dict:
    """Centre, deviations and inverse covariance of standardised columns. The small matrix is inverted on the driver.

    Each task adds up products of centred values in a matrix of fixed size; an aggregate for each pair would make a plan
    of a thousand columns.
    """
    size = len(columns)
    row = df.agg(F.count("*").alias("n"), *(F.avg(c).alias(f"m_{c}") for c in columns)).first()
    mean = np.array([row[f"m_{c}"] or 0.0 for c in columns])
    if row.n < 5:
        return {"mean": mean, "std": np.ones(size), "inverse": np.eye(size)}

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros((size, size))
        for batch in batches:
            x = np.stack([np.asarray(c.fill_null(np.nan)) for c in batch.columns], axis=1) - mean
            x = np.nan_to_num(x)
            own += x.T @ x
        i, j = np.divmod(np.arange(size * size), size)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(own.ravel())], names=["i", "j", "v"])

    sums = df.select(*(F.col(c).cast("double") for c in columns)).mapInArrow(products, "i bigint, j bigint, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    cov = np.zeros((size, size))
    for r in sums.collect():  # one row for each pair of columns
        cov[r.i, r.j] = r.v / row.n
    std = np.sqrt(np.maximum(np.diag(cov), 0))
    std[std < 1e-6] = 1.0
    return {"mean": mean, "std": std, "inverse": np.linalg.pinv(cov / np.outer(std, std) + 1e-3 * np.eye(size))}


def _sum(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols, F.lit(0.0))


def distances(df: DataFrame, columns: list[str], base: dict | None) -> DataFrame:
    """Euclidean, Mahalanobis and cosine against a baseline; (0, 0, 1) without one."""
    if base is None:
        return df.withColumns({"dist_euclidean": F.lit(0.0), "dist_mahalanobis": F.lit(0.0), "dist_cosine": F.lit(1.0)})
    z = [(F.col(c) - float(m)) / float(s) for c, m, s in zip(columns, base["mean"], base["std"])]
    norm_mean = float(np.linalg.norm(base["mean"]))
    dot, norm = _sum([F.col(c) * float(m) for c, m in zip(columns, base["mean"])]), F.sqrt(_sum([F.col(c) * F.col(c) for c in columns]))
    inverse, mean, std = base["inverse"], base["mean"], base["std"]

    @F.pandas_udf("double")
    def mahalanobis(x: pd.Series) -> pd.Series:
        d = (np.stack(x.to_numpy()) - mean) / std if len(x) else np.zeros((0, len(mean)))
        return pd.Series(np.sqrt(np.maximum(0, np.einsum("ij,jk,ik->i", d, inverse, d))))

    cosine = F.when((norm < 1e-9) | F.lit(norm_mean < 1e-9), 1.0).otherwise(dot / (F.greatest(norm, F.lit(1e-300)) * (norm_mean or 1.0)))
    return df.withColumns({"dist_euclidean": F.sqrt(_sum([v * v for v in z])), "dist_mahalanobis": mahalanobis(F.array(*columns)), "dist_cosine": cosine})


def dispersion(paragraphs: DataFrame, columns: list[str]) -> DataFrame:
    """Mean over columns of their population variance over a document's paragraphs; 0 for one paragraph."""
    agg = paragraphs.groupBy("doc_id").agg(*(F.var_pop(c).alias(c) for c in columns))
    return agg.select("doc_id", (_sum([F.col(c) for c in columns]) / len(columns)).alias("dist_structural_dispersion"))


def score(df: DataFrame, weights: dict[str, tuple[float, float, float]], intercept: float) -> DataFrame:
    """logit and probability: standardised values, held to +-3.5, times weights (coefficient, mean, scale); clipped to .01-.99."""
    z = {c: F.greatest(F.lit(-3.5), F.least(F.lit(3.5), (F.coalesce(c, F.lit(0.0)) - m) / (s if s >= 1e-6 else 1.0))) * k for c, (k, m, s) in weights.items()}
    out = df.withColumn("logit", _sum(list(z.values())) + intercept)
    return out.withColumn("probability", F.greatest(F.lit(0.01), F.least(F.lit(0.99), 1 / (1 + F.exp(-F.col("logit"))))))


def long_form(df: DataFrame, columns: list[str]) -> DataFrame:
    """doc_id, ord, feature, observed: a row for each measurement."""
    rows = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(c).alias("feature"), F.col(c).cast("double").alias("observed")) for i, c in enumerate(columns)))
    return df.select("doc_id", F.explode(rows).alias("r")).select("doc_id", "r.*")


def impacts(long: DataFrame, table: DataFrame) -> DataFrame:
    """Adds impact and direction by looking each feature up in a model's table; one that it doesn't have counts nothing.

    The table has a row for each feature: it is broadcast, and its size doesn't grow with the data.
    """
    known = table.select("feature", "coefficient", "mean", "scale")
    of = lambda c, default: F.coalesce(F.col(c), F.lit(default))
    z = (F.coalesce("observed", F.lit(0.0)) - of("mean", 0.0)) / F.when(of("scale", 1.0) >= 1e-6, F.col("scale")).otherwise(1.0)
    impact = F.round(F.greatest(F.lit(-3.5), F.least(F.lit(3.5), F.coalesce(z, F.lit(0.0)))) * of("coefficient", 0.0), 4)
    out = long.join(F.broadcast(known), "feature", "left").withColumn("impact", impact)
    return out.withColumn("direction", F.when(F.col("impact") > 0, "AI-skewed").otherwise("Human-skewed")).drop("coefficient", "mean", "scale")


def contributions(df: DataFrame, columns: list[str], table: DataFrame, top: int = 5) -> DataFrame:
    """doc_id, feature, observed, impact, direction, rank: the largest impacts of either direction, by a model's table."""
    long = impacts(long_form(df, columns), table)
    rank = F.row_number().over(Window.partitionBy("doc_id", "direction").orderBy(F.abs("impact").desc(), "ord")).cast("long")
    return long.withColumn("rank", rank).where(F.col("rank") <= top).drop("ord").select("doc_id", "feature", "observed", "impact", "direction", "rank")


def score_by_table(df: DataFrame, columns: list[str], table: DataFrame) -> DataFrame:
    """Adds logit, probability and the model's version; the table comes as one row that holds its features as a map."""
    entries = F.map_from_entries(F.collect_list(F.struct("feature", F.struct("coefficient", "mean", "scale"))))
    one = table.groupBy("version").agg(entries.alias("_m"))
    value = lambda c, k, default: F.coalesce(F.col("_m")[c][k], F.lit(default))
    clipped = lambda c: F.greatest(F.lit(-3.5), F.least(F.lit(3.5), (F.coalesce(c, F.lit(0.0)) - value(c, "mean", 0.0)) / F.when(value(c, "scale", 1.0) >= 1e-6, value(c, "scale", 1.0)).otherwise(1.0)))
    logit = _sum([clipped(c) * value(c, "coefficient", 0.0) for c in columns]) + value(files.INTERCEPT, "coefficient", 0.0)
    out = df.crossJoin(F.broadcast(one)).withColumn("logit", logit)
    return out.withColumn("probability", F.greatest(F.lit(0.01), F.least(F.lit(0.99), 1 / (1 + F.exp(-F.col("logit")))))).drop("_m")


def fit_logistic(df: DataFrame, columns: list[str], label: str = "label", c: float = 1.0):
    """L2 logistic regression on standardised columns: weights (coefficient, mean, scale) by column, and the intercept."""
    return fit_many(df, {"": columns}, label, c)[""]


def fit_many(df: DataFrame, families: dict[str, list[str]], label: str = "label", c: float = 1.0, tolerance: float = 1e-9, most: int = 100) -> dict[str, tuple[dict[str, tuple[float, float, float]], float]]:
    """L2 logistic regressions of several families of columns, all in the same scans: weights by column, and the intercept.

    Newton steps on the sum of log losses times c plus half the squared weights (the intercept goes free). Each pass adds
    up, in every task, the loss, gradient and Hessian of each family at its own point; the sums, of a size that columns
    alone give, are solved on the driver. A step that makes the loss greater is halved. Nulls count as the mean.
    """
    columns = sorted({x for own in families.values() for x in own})
    stats = moments(df, columns)
    mean, scale = np.array([stats[x][0] for x in columns]), np.array([stats[x][1] or 1.0 for x in columns])
    places = {name: np.array([columns.index(x) for x in own], int) for name, own in families.items()}
    rows = df.select(*(F.col(x).cast("double").alias(x) for x in columns), F.col(label).cast("double").alias("_y")).where("_y is not null")
    point = {name: np.zeros(len(own) + 1) for name, own in families.items()}  # the intercept comes last

    def sums_at(points: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        shipped = df.sparkSession.sparkContext.broadcast(points)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = {name: np.zeros(1 + len(w) + len(w) ** 2) for name, w in shipped.value.items()}
            for batch in batches:
                x = np.stack([np.asarray(v.fill_null(np.nan), float) for v in batch.columns[:-1]], axis=1)
                x = np.where(np.isnan(x), 0.0, (x - mean) / scale)
                y = np.asarray(batch.columns[-1], float)
                for name, w in shipped.value.items():
                    own = np.column_stack([x[:, places[name]], np.ones(len(y))])
                    logit = own @ w
                    p = 1 / (1 + np.exp(-np.clip(logit, -700, 700)))
                    total[name] += np.concatenate([[np.sum(np.logaddexp(0, logit) - y * logit)], own.T @ (p - y), (own.T @ (own * (p * (1 - p))[:, None])).ravel()])
            for name, v in total.items():
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(v)), pa.array(np.arange(len(v))), pa.array(v)], names=["family", "i", "v"])

        out = {name: np.zeros(1 + len(w) + len(w) ** 2) for name, w in points.items()}
        for r in rows.mapInArrow(run, "family string, i bigint, v double").groupBy("family", "i").agg(F.sum("v").alias("v")).collect():
            out[r.family][r.i] = r.v
        return out

    def penalised(name: str, sums: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        ridge = np.append(np.ones(len(w) - 1), 0.0)
        return c * sums[0] + 0.5 * float(ridge @ (w * w)), c * sums[1 : 1 + len(w)] + ridge * w, c * sums[1 + len(w) :].reshape(len(w), len(w)) + np.diag(ridge)

    state = {name: penalised(name, v, point[name]) for name, v in sums_at(point).items()}
    step = {name: -np.linalg.lstsq(state[name][2], state[name][1], rcond=None)[0] for name in families}
    moving = set(families)
    for _ in range(most):
        if not moving:
            break
        tried = {name: point[name] + step[name] for name in moving}
        for name, sums in sums_at(tried).items():
            new = penalised(name, sums, tried[name])
            if new[0] > state[name][0] + 1e-12 * abs(state[name][0]):
                step[name] = step[name] / 2
                if np.abs(step[name]).max() < tolerance:
                    moving.discard(name)
                continue
            if np.abs(step[name]).max() < tolerance:
                moving.discard(name)
            point[name], state[name] = tried[name], new
            step[name] = -np.linalg.lstsq(new[2], new[1], rcond=None)[0]
    return {name: ({x: (float(w), stats[x][0], stats[x][1] or 1.0) for x, w in zip(own, point[name])}, float(point[name][-1])) for name, own in families.items()}


def fit_forest(df: DataFrame, columns: list[str], label: str = "label", seed: int = 42):
    ready = VectorAssembler(inputCols=columns, outputCol="x").transform(df).withColumn("label", F.col(label).cast("double"))
    return RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=100, maxDepth=6, minInstancesPerNode=2, featureSubsetStrategy="sqrt", seed=seed).fit(ready)


def predict_forest(m, df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds p (probability of class 1) and pred.

    A copy of the model votes: the fitted one holds its training summary and, by it, the session, which can't be sent to
    tasks once a write has been observed in it.
    """
    ready = VectorAssembler(inputCols=columns, outputCol="_x").transform(df)
    out = m.copy().setFeaturesCol("_x").setProbabilityCol("_p").setRawPredictionCol("_raw").setPredictionCol("_class").transform(ready)
    p = vector_to_array("_p")[1]
    return out.withColumns({"p": p, "pred": F.when(p >= 0.5, 1).otherwise(0)}).drop("_x", "_p", "_raw", "_class")


def trees_of(m) -> list[dict[str, np.ndarray]]:
    """The forest's trees as arrays by node: feature (-1: a leaf), threshold, left, right and share of class 1."""
    path = f"{files.shared_dir(SparkSession.active())}/forest-{uuid.uuid4().hex}"
    m.write().save(path)
    by: dict[int, list] = {}
    for r in SparkSession.active().read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect():  # a node is a row: 127 at most for each tree of depth 6
        by.setdefault(r.treeID, []).append(r)
    out = []
    for own in by.values():
        own.sort(key=lambda r: r.id)
        stats = np.array([r.impurityStats for r in own])
        leaf = np.array([r.leftChild < 0 for r in own])
        out.append({"feature": np.where(leaf, -1, [r.split.featureIndex for r in own]), "threshold": np.array([0.0 if r.leftChild < 0 else r.split.leftCategoriesOrThreshold[0] for r in own]), "left": np.array([r.leftChild for r in own]), "right": np.array([r.rightChild for r in own]), "share": stats[:, 1] / stats.sum(1)})
    return out


def tree_votes(tree: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Share of class 1 in the leaf that each row falls in."""
    at = np.zeros(len(x), int)
    while True:
        feature = tree["feature"][at]
        inner = np.flatnonzero(feature >= 0)
        if not len(inner):
            return tree["share"][at]
        own = at[inner]
        at[inner] = np.where(x[inner, feature[inner]] <= tree["threshold"][own], tree["left"][own], tree["right"][own])


def permutation_importance(m, df: DataFrame, columns: list[str], label: str = "label", repeats: int = 10, seed: int = 42) -> DataFrame:
    """feature, mean and std of the accuracy lost where a column's values are dealt anew, over repeats.

    Rows get numbers in the parts they are in; each repeat joins every row once with the one that a keyed permutation
    gives it, and all columns are tried on that pair: for each, only the trees that ask for it vote again. Tasks add up
    how often they are right.
    """
    trees, size = trees_of(m), len(columns)
    asks = [np.unique(t["feature"][t["feature"] >= 0]) for t in trees]
    rows, n = ranks.numbered(df.select(F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns)).alias("v"), F.col(label).cast("int").alias("y")))
    if not n:
        return df.sparkSession.createDataFrame([], "feature string, permutation_mean double, permutation_std double")
    shipped = df.sparkSession.sparkContext.broadcast((trees, asks))
    turns = reduce(lambda a, b: a.unionByName(b), [rows.select(F.lit(r).alias("turn"), "v", "y", ranks.permuted(F.col("row"), n, seed, r).alias("row")) for r in range(repeats)])
    dealt = turns.join(rows.select("row", F.col("v").alias("o")), "row").select("turn", "y", "v", "o")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, asks = shipped.value
        right = np.zeros((repeats, size + 1), np.int64)  # the last: nothing dealt anew
        for batch in batches:
            flat = lambda c: batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            x, o = flat("v"), flat("o")
            turn, y = (np.asarray(batch.column(c)) for c in ("turn", "y"))
            votes = [tree_votes(t, x) for t in trees]
            whole = np.sum(votes, axis=0)
            for k in range(size + 1):
                changed = whole
                if k < size:
                    swapped = x.copy()
                    swapped[:, k] = o[:, k]
                    changed = whole + sum((tree_votes(t, swapped) - v for t, v, a in zip(trees, votes, asks) if k in a), np.zeros(len(x)))
                right[:, k] += np.bincount(turn, (changed >= 0.5 * len(trees) - 1e-9) == y, repeats).astype(np.int64)
        i, k = np.divmod(np.arange(right.size), size + 1)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(right.ravel())], names=["turn", "k", "hits"])

    hits = np.zeros((repeats, size + 1))
    for r in dealt.mapInArrow(run, "turn int, k int, hits bigint").groupBy("turn", "k").agg(F.sum("hits").alias("hits")).collect():  # repeats x (columns + 1) rows
        hits[r.turn, r.k] = r.hits / n
    lost = hits[:, -1:] - hits[:, :-1]
    return df.sparkSession.createDataFrame([(c, float(lost[:, k].mean()), float(lost[:, k].std())) for k, c in enumerate(columns)], "feature string, permutation_mean double, permutation_std double")


def weights_table(spark, weights: dict[str, tuple[float, float, float]]) -> DataFrame:
    rows = [(k, float(w), abs(float(w)), float(np.exp(w)), "Higher -> AI" if w > 0 else "Higher -> Human") for k, (w, _, _) in weights.items()]
    return spark.createDataFrame(rows, "feature string, coefficient double, magnitude double, odds_ratio double, direction string").orderBy(F.desc("magnitude"), "feature")


def evaluate(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Confusion counts, rates, ROC-AUC (average ranks; 0.5 for one class) and Brier score of y, pred, p, whole or by columns."""
    by = by or []
    # Sums of ranks come from counts at each score and a prefix sum over ranges of scores: no task sees all of them.
    at = df.groupBy(*by, "p").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    ranked = ranks.before(at, "p", "n", by)
    rank_sum = ranked.groupBy(*by).agg(F.sum(F.col("pos") * (F.col("before") + (F.col("n") + 1) / 2)).alias("_r"))
    cell = lambda y, p: F.count_if((F.col("y") == y) & (F.col("pred") == p))
    agg = df.groupBy(*by).agg(F.count("*").alias("n"), cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp"), F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("brier_score"))
    agg = agg.join(rank_sum, by) if by else agg.crossJoin(rank_sum)
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    pos, neg = tp + fn, tn + fp
    return agg.withColumns({"accuracy": ratio(tp + tn, F.col("n")), "precision": ratio(tp, tp + fp), "recall": ratio(tp, pos), "f1": ratio(2 * tp, 2 * tp + fp + fn), "false_positive_rate": ratio(fp, neg), "false_negative_rate": ratio(fn, pos), "roc_auc": F.coalesce(F.try_divide(F.col("_r") - pos * (pos + 1) / 2, (pos * neg).cast("double")), F.lit(0.5))}).drop("_r")


def disparity(df: DataFrame, column: str, group_a, group_b) -> DataFrame:
    """One row: false positive rates of two groups of human rows and their ratio; a status where it can't be told."""
    if column not in df.columns:
        return df.sparkSession.sql("select 'NOT_EVALUATED' as status, cast(null as double) fpr_a, cast(null as double) fpr_b, cast(null as double) ratio")
    human = F.col("y") == 0
    n = lambda g: F.count_if(human & (F.col(column) == g))
    rate = lambda g: F.avg(F.when(human & (F.col(column) == g), F.col("pred").cast("double")))
    row = df.agg(n(group_a).alias("a"), n(group_b).alias("b"), rate(group_a).alias("ra"), rate(group_b).alias("rb"))
    known = (F.col("a") > 0) & (F.col("b") > 0)
    return row.select(F.when(known, "EVALUATED").otherwise("INSUFFICIENT_METADATA").alias("status"), F.when(known, F.col("ra")).alias("fpr_a"), F.when(known, F.col("rb")).alias("fpr_b"), F.when(known, F.col("ra") / F.greatest("rb", F.lit(1e-5))).alias("ratio"))


def failures(df: DataFrame, k: int = 10, carry: tuple[str, ...] = ()) -> DataFrame:
    """The k surest false positives and false negatives, with a snippet and the columns to carry. A report: the limit is its feature."""
    snippet = F.concat(F.substring("text", 1, 300), F.lit("..."))
    own = ["doc_id", "p", "y", "pred", *(c for c in ("lang", "source", "words") if c in df.columns), snippet.alias("snippet"), *carry]
    fp = df.where("y = 0 and pred = 1").orderBy(F.desc("p"), "doc_id").limit(k).select(F.lit("false_positive").alias("kind"), *own)
    fn = df.where("y = 1 and pred = 0").orderBy("p", "doc_id").limit(k).select(F.lit("false_negative").alias("kind"), *own)
    return fp.unionByName(fn)


def anomalies(failed: DataFrame, human: DataFrame, weights: dict[str, tuple[float, float, float]], top: int = 4) -> DataFrame:
    """Adds top_features to failed rows: the ``top`` measurements of the largest impact, either way, of how far they are from human rows.

    Array of struct(feature, value, human_mean, z_score, model_impact). z is (value - mean) over the sample deviation of
    human rows (zero counts as 1), not clipped; the impact is z times the coefficient. Ties go to the earlier feature.
    """
    row = human.agg(*(f(c).alias(f"{n}_{c}") for c in weights for n, f in (("m", F.avg), ("s", F.stddev_samp)))).first()

    def one(i: int, c: str, w: float) -> Column:
        mean, std = row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0
        z = (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - mean) / std
        own = F.struct(F.lit(c).alias("feature"), F.round(c, 4).alias("value"), F.lit(round(mean, 4)).alias("human_mean"), F.round(z, 2).alias("z_score"), F.round(z * w, 3).alias("model_impact"))
        return F.struct((-F.abs(F.round(z * w, 3))).alias("least"), F.lit(i).alias("ord"), own.alias("own"))

    return failed.withColumn("top_features", F.transform(F.slice(F.array_sort(F.array(*(one(i, c, w) for i, (c, (w, _, _)) in enumerate(weights.items())))), 1, top), lambda x: x["own"]))


def quantiles(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, mean, std (population, tiny counts as 1), median, p10, p90 (linear): exact, by repeated counts over ranges."""
    stats, found = moments(df, columns), ranks.quantiles(df, columns, (0.5, 0.1, 0.9))
    rows = [(c, *map(float, stats[c]), *found[c]) for c in columns]
    return df.sparkSession.createDataFrame(rows, "feature string, mean double, std double, median double, p10 double, p90 double").withColumn("std", F.when(F.col("std") <= 1e-6, 1.0).otherwise(F.col("std")))
